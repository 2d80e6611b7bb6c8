"""Commercial evidence in speech: cue lexicons with offsets, content types, blocks of selling, risk states.

Cues are looked for in folded text (lower case, no accents), where every letter keeps its place, so offsets are those of the
given text. Missing evidence is null; what is reported or negated is no offer.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, sql_pattern
from .intervals import SECOND
from .lineage import cut, spread

# Signals and their patterns, the signals that a negation cancels, exceptions (signal, match, what follows),
# signals of selling, content types that are commercial.
CUES = (
    ("price", r"\br\s*\$\s*\d[\d.,]*|\b\d[\d.,]*\s*(?:reais|mil)\b|\b\d{1,5},\d{2}\b|\bpreco\b.{0,35}\d|\bpor apenas\b|\bde (?:cento|cinquenta|sessenta|setenta|oitenta|noventa)\b.{0,90}\bpor (?:cento|cinquenta|sessenta|setenta|oitenta|noventa)\b"),
    ("installment", r"\b\d{1,3}\s*(?:x\b|de\s+\d[\d.,]*|vezes\b)|\b(?:em|ate)\s+(?:\d{1,3}|dez|doze)\s*vezes\b|\bparcelas?\b|\btaxa zero\b|\bsem entrada e sem juros\b"),
    ("discount", r"\b(?:descontos?|cupom|promocao|promocoes|ofertas?|parcelamento|metade do preco)\b"),
    ("store", r"\b(?:lojas?|estoque|vendas? abertas?|pronta entrega|campanha de vendas)\b"),
    ("product", r"\b(?:produtos?|suplementos?|magnesio|vitaminas?|colageno|sofa(?:-?cama)?|poltronas?|cadeiras?|moveis|mobiliario|decoracoes?|couro|carros?|veiculos?|capsulas?|medicamentos?|cursos?|livros?)\b"),
    ("sales_cta", r"\b(?:compre|adquira|aproveit[ae]|garant[ae]|(?:ja |voce ja )?garantiu|peca agora|ligue|acesse a loja|venha conferir|corre la|correria agora|pode ir na loja|quer patrocinar)\b"),
    ("recommendation", r"\b(?:use|tome|experimente)\s+(?:(?:o|a|os|as|este|esse|essa|esta)\s+)?\w+"),
    ("contact", r"\b(?:telefone|whatsapp|entre em contato)\b|\b[\w.+-]+@[\w.-]+\.[a-z]{2,}\b"),
    ("domain", r"\b(?:https?://|www\.)?[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|net|org|com\.br|br)\b"),
    ("urgency", r"\b(?:imperdivel|so hoje|ultima oportunidade|ultimos dias|vai esgotar|vendas abertas|pronta entrega|super valorizacao)\b"),
    ("payment", r"\b(?:pix|sem juros|sem entrada)\b"),
    ("health_claim", r"\bdesinflam\w*|\balivi\w*.{0,45}\bdor\b|\b(?:combate|elimina).{0,30}\b(?:dores?|inflamacao)\b"),
    ("benefit_claim", r"\b(?:melhor produto|resultado garantido|super valorizacao|qualidade superior)\b"),
    ("event", r"\b(?:ingressos?|bilheteria|shows?|eventos?|tickets?)\b"),
    ("guest_invitation", r"\b(?:venha|venham|convido voces)\b.{0,60}\bmeu (?:show|evento)\b"),
    ("sponsor", r"\b(?:oferecimento|oferecido por|conteudo patrocinado|patrocinado por|nosso patrocinador|patrocinador deste programa)\b"),
    ("sponsorship_mention", r"\b(?:patrocinador|patrocinio|patrocinar)\b"),
)
NEGATABLE = ("sales_cta", "recommendation", "health_claim", "discount", "sponsor", "urgency", "guest_invitation")
NEGATION = r"\b(?:nao|nunca|sem)\s+(?:\w+\s+){0,2}$"
EXCEPTIONS = (("price", r"^\d[\d.,]*\s+mil$", r"^\s+pes\b"), ("installment", r"^\d{1,3}\s+vezes$", r"^\s+a\s+forca\s+da\s+gravidade\b"))
SALE_SIGNALS = ("price", "installment", "discount", "store", "product", "sales_cta", "urgency", "payment", "sponsor", "event", "domain", "contact", "recommendation", "health_claim", "benefit_claim", "guest_invitation")
COMMERCIAL_TYPES = ("advertisement", "sponsor_read", "merchandising", "commercial_promotion", "event_promotion", "self_promotion")
OWN_WORK = r"\b(?:meu livro|meu curso|meu show)\b"
HOUSEKEEPING = r"\b(?:inscreva|se inscreve|compartilhe|deixe o like|segue o canal)\b"
INTRO = r"\b(?:bem vindos|boa noite pessoal|ate o proximo programa|encerramos)\b"
REPORTED = r"\b(?:a propaganda dizia|o anuncio dizia|segundo o anuncio|na reportagem|discutimos a propaganda|criticamos a propaganda|a marca anunciava)\b"
AFFILIATE = r"\b(?:links? de afiliad[oa]s?|sou afiliad[oa]|somos afiliad[oa]s|(?:ganho|ganhamos|recebo|recebemos) (?:uma )?comissao)\b"
MEASUREMENT = r"\b\d[\d.,]*\s+mil\s+pes\b|\b\d{1,3}\s+vezes\s+a\s+forca\s+da\s+gravidade\b"
CONTEXT_NEGATION = r"\b(?:nao|nunca|sem|nenhum|nenhuma)\s+(?:\w+\s+){0,4}$"


def scan(text: Column, pattern: str, start: Column, step: Callable[[Column, Column, Column], Column]) -> Column:
    """Folds over all matches of a pattern: step(state, offset of the match, match); start gives the state. Linear in the text."""
    pattern = sql_pattern(pattern)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.split(text, pattern, -1)
    both = F.zip_with(F.slice(parts, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))

    def one(s: Column, x: Column) -> Column:
        at = s["at"] + F.length(x["p"])
        return F.struct((at + F.length(x["m"])).alias("at"), step(s["state"], at, x["m"]).alias("state"))

    return F.aggregate(both, F.struct(F.lit(0).alias("at"), start.alias("state")), one, lambda s: s["state"])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once and standing once in the expression, however often body names it: filters on the result then stay small when they are pushed down."""
    return F.transform(F.array(value), body)[0]


def before(text: Column, at: Column, n: int) -> Column:
    """The n characters before an offset."""
    return F.substring(text, F.greatest(at - n, F.lit(0)) + 1, F.least(at, F.lit(n)))


def _hits(low: Column, signal: str, pattern: str, most: int) -> Column:
    """The first `most` matches that are no exceptions, less those that are negated: start, length."""
    none = F.array().cast("array<struct<start:int,length:int>>")

    def step(hits: Column, at: Column, m: Column) -> Column:
        end = at + F.length(m)
        skip = [m.rlike(sql_pattern(own)) & F.substring(low, end + 1, F.lit(60)).rlike(sql_pattern(after)) for s, own, after in EXCEPTIONS if s == signal]
        full = reduce(lambda a, b: a | b, skip, F.size(hits) >= most)
        return F.when(full, hits).otherwise(F.concat(hits, F.array(F.struct(at.alias("start"), F.length(m).alias("length")))))

    found = scan(low, pattern, none, step)
    if signal in NEGATABLE:
        found = F.filter(found, lambda h: ~before(low, h["start"], 24).rlike(sql_pattern(NEGATION)))
    return F.when(low.rlike(sql_pattern(pattern)), found).otherwise(none)


def _spans(low: Column, most: int = 3) -> Column:
    named = lambda signal: lambda h: F.struct(F.lit(signal).alias("signal"), h["start"].alias("start"), h["length"].alias("length"))
    each = [F.transform(_hits(low, s, p, most), named(s)) for s, p in CUES]
    # one pass over the text tells whether any cue is there at all
    any_cue = low.rlike(sql_pattern("|".join(p for _, p in CUES)))
    return F.when(any_cue, F.concat(*each)).otherwise(F.array().cast("array<struct<signal:string,start:int,length:int>>"))


def folded(text: Column) -> Column:
    return fold(F.coalesce(text, F.lit("")))


def cue_spans(text: Column, most: int = 3) -> Column:
    """array of (signal, start, length): up to `most` matches of each signal."""
    return let(folded(text), lambda low: _spans(low, most))


def cue_hits(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """One row for each span: signal, start_char, end_char and the literal text there."""
    each = df.select(*key, F.col(text).alias("_text"), F.explode(cue_spans(F.col(text))).alias("h"))
    return each.select(*key, "h.signal", F.col("h.start").alias("start_char"), (F.col("h.start") + F.col("h.length")).alias("end_char"), F.substring("_text", F.col("h.start") + 1, F.col("h.length")).alias("hit"))


def _typed(low: Column, signals: Column) -> Column:
    """signals, content_type, commercial_score, reported, strong: the first rule that holds."""
    has = lambda *xs: reduce(lambda a, b: a & b, [F.array_contains(signals, x) for x in xs])
    some = lambda *xs: reduce(lambda a, b: a | b, [F.array_contains(signals, x) for x in xs])
    n = F.size(signals)
    offer = has("installment", "urgency") | has("price", "installment", "store")
    health = has("recommendation", "product", "health_claim")
    selling = has("sales_cta") & some("price", "discount", "domain", "store", "contact", "event")
    strong = offer | health | has("store", "discount", "payment") | selling | has("guest_invitation")
    weak = has("sales_cta") | (has("recommendation") & some("price", "domain", "health_claim"))
    cases = [
        (has("sponsor"), "sponsor_read", F.lit(0.85)),
        (strong & has("event"), "event_promotion", F.least(F.lit(0.96), 0.7 + 0.04 * n)),
        (strong & low.rlike(sql_pattern(OWN_WORK)), "self_promotion", F.lit(0.8)),
        (health, "commercial_promotion", F.lit(0.85)),
        (strong, "advertisement", F.least(F.lit(0.96), 0.65 + 0.05 * n)),
        (low.rlike(sql_pattern(HOUSEKEEPING)), "housekeeping", F.lit(0.0)),
        (low.rlike(sql_pattern(INTRO)), "intro_outro", F.lit(0.0)),
        (weak, "uncertain", F.lit(0.35)),
        (some("product", "price", "sponsorship_mention"), "editorial_product_discussion", F.lit(0.0)),
        (F.trim(low) == "", "uncertain", F.lit(None).cast("double")),
    ]
    pick = lambda k, last: reduce(lambda c, x: c.when(x[0], x[k]), cases, F).otherwise(last)
    return F.struct(signals.alias("signals"), pick(1, "editorial_content").alias("content_type"), F.round(pick(2, 0.0), 6).alias("commercial_score"), low.rlike(sql_pattern(REPORTED)).alias("reported"), (strong | has("sponsor")).alias("strong"))


def _judged(c: Column) -> Column:
    commercial = c["content_type"].isin(*COMMERCIAL_TYPES)
    eligibility = F.when(commercial & c["reported"], "review").when(commercial, "excluded").when(c["content_type"] == "uncertain", "review").otherwise("eligible")
    kind = F.when(c["reported"] & c["strong"], "reported_offer").when(c["content_type"].isin("self_promotion", "event_promotion"), "guest_promotional_invitation").when(commercial, "paid_ad_or_sales_offer").when(eligibility == "review", "ambiguous").otherwise("neutral_mention")
    return F.struct(c["signals"].alias("signals"), c["content_type"].alias("content_type"), c["commercial_score"].alias("commercial_score"), c["reported"].alias("reported"), eligibility.alias("eligibility"), kind.alias("commercial_kind"))


def classification(text: Column) -> Column:
    """A struct of signals (sorted), content_type, commercial_score, reported, eligibility (eligible, review, excluded), commercial_kind."""
    signals = lambda low: F.array_sort(F.array_distinct(F.transform(_spans(low), lambda h: h["signal"])))
    return let(folded(text), lambda low: let(let(signals(low), lambda x: _typed(low, x)), _judged))


def classify_content(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the fields of classification()."""
    return df.withColumn("_found", classification(F.col(text))).select("*", "_found.*").drop("_found")


def commercial_context(df: DataFrame, text: str = "text") -> DataFrame:
    """What kind of mention a text makes, and what speaks against taking it for an offer. Scores and gates stay as they are."""
    low = folded(F.col(text))
    df = classify_content(df, text)
    ok = lambda p: scan(low, p, F.lit(False), lambda s, at, m: s | ~before(low, at, 48).rlike(sql_pattern(CONTEXT_NEGATION)))
    negated = lambda p: scan(low, p, F.lit(False), lambda s, at, m: s | before(low, at, 48).rlike(sql_pattern(CONTEXT_NEGATION)))
    has = lambda x: F.array_contains("signals", x)
    df = df.withColumn("affiliate", ok(AFFILIATE)).withColumn("quoted", F.col("reported") & ((F.col("commercial_kind") == "reported_offer") | has("sales_cta") | F.col("affiliate")))
    empty = F.trim(low) == ""
    named = F.when(empty | F.col("quoted"), "uncertain").when(F.col("affiliate"), "affiliate").when(has("sponsor"), "sponsorship").when(F.col("content_type").isin(*COMMERCIAL_TYPES), "advertisement").when(has("sales_cta"), "call_to_purchase").when(has("price"), "factual_price_mention").when(has("domain"), "contextual_website_reference").when(has("product"), "product_discussion").otherwise("uncertain")
    df = df.withColumn("classification", named)
    nothing = (F.col("classification") == "uncertain") & ~empty & ~F.col("quoted")
    flags = [(low.rlike(sql_pattern(MEASUREMENT)), "physical_quantity"), (F.col("quoted"), "reported_offer"), (negated(AFFILIATE) | negated(MEASUREMENT), "negated_mention"), (empty, "no_text"), (nothing, "no_cue")]
    return df.withColumn("flags", F.array_compact(F.array(*(F.when(c, F.lit(x)) for c, x in flags)))).drop("affiliate", "quoted")


def commercial_blocks(segments: DataFrame, gap_us: int = 1_500_000, merge_us: int = 2_000_000, lead_us: int = 1_000_000) -> DataFrame:
    """Stretches of selling: source_id, block_no, start_us, end_us, segment_ids, signals, state.

    A segment that is excluded by itself seeds a block; so do the segments with signals of selling in the shortest window of
    2 to 4 neighbours (gaps up to gap_us) whose joined text is excluded. Neighbouring seeds up to merge_us apart are one block,
    with the segment right before it if that has two signals, is no reported offer and no other voice. An offer split over
    different voices asks for review; else the block's joined text decides.
    """
    order = Window.partitionBy("source_id").orderBy("start_us", "end_us", "segment_id")
    voice = F.when(F.upper(F.trim("speaker")).isin("", "UNKNOWN", "UNASSIGNED"), None).otherwise(F.col("speaker"))
    sale = F.array(*map(F.lit, SALE_SIGNALS))
    s = classify_content(spread(segments.select("source_id", "segment_id", "start_us", "end_us", F.coalesce("text", F.lit("")).alias("text"), voice.alias("voice")), "source_id", "segment_id"))
    # cues are looked for once: what follows reads the segments and the seeds more than once
    s = cut(s.withColumn("selling", F.array_intersect("signals", sale)).withColumn("pos", F.row_number().over(order)).select("source_id", "segment_id", "start_us", "end_us", "text", "voice", "signals", "selling", "eligibility", "reported", "pos"))
    me = F.struct("pos", "start_us", "end_us", "text", "voice", (F.size("selling") > 0).alias("marked"), (F.col("eligibility") == "excluded").alias("excluded"))
    w = s.withColumn("me", me)
    w = w.select("source_id", "pos", F.array("me", *(F.lead("me", k).over(order) for k in (1, 2, 3))).alias("next"))
    near = lambda k: F.coalesce(F.col("next")[k]["start_us"] - F.col("next")[k - 1]["end_us"] <= gap_us, F.lit(False))
    reach = F.when(~near(1), 1).when(~near(2), 2).when(~near(3), 3).otherwise(4)
    w = spread(w.withColumn("reach", reach).where("reach > 1"), "source_id", "pos")
    # longer windows are only looked at where the shorter ones are not excluded
    excluded = lambda n: classification(F.array_join(F.transform(F.slice("next", F.lit(1), n), lambda x: x["text"]), " "))["eligibility"] == "excluded"
    shortest = F.aggregate(F.sequence(F.lit(2), "reach"), F.lit(None).cast("int"), lambda found, n: F.when(found.isNotNull(), found).when(excluded(n), n))
    own = F.transform(F.slice("next", F.lit(1), F.col("n")), lambda x: F.struct(*(x[f].alias(f) for f in ("pos", "voice", "marked", "excluded"))))
    shortest = cut(w.select("source_id", "next", shortest.alias("n")).select("source_id", own.alias("own"))).where("own is not null")
    seeds = shortest.select("source_id", F.filter("own", lambda x: x["marked"]).alias("marked"), F.size(F.array_compact(F.array_distinct(F.transform("own", lambda x: x["voice"])))).alias("voices"))
    split = (F.col("voices") > 1) & ~F.exists("marked", lambda x: x["excluded"])
    seeds = seeds.select("source_id", split.alias("split"), F.explode("marked").alias("m")).select("source_id", "m.pos", "split").unionByName(s.where("eligibility = 'excluded'").select("source_id", "pos", F.lit(False).alias("split")))
    seeds = seeds.groupBy("source_id", "pos").agg(F.bool_or("split").alias("split")).join(s, ["source_id", "pos"])
    by = Window.partitionBy("source_id").orderBy("pos")
    run = seeds.withColumn("island", F.col("pos") - F.row_number().over(by))
    inside = Window.partitionBy("source_id", "island").orderBy("pos")
    ended = F.max("end_us").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    run = run.withColumn("fresh", F.coalesce((F.col("start_us") > ended + merge_us).cast("int"), F.lit(1)))
    run = run.withColumn("block_no", F.sum("fresh").over(by))
    row = F.struct("pos", "segment_id", "text")
    blocks = cut(run.groupBy("source_id", "block_no").agg(F.min("pos").alias("first"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.array_sort(F.collect_list(row)).alias("rows"), F.array_distinct(F.flatten(F.collect_list("signals"))).alias("signals"), F.collect_set("voice").alias("voices"), F.bool_or("split").alias("split")))
    # the segment that ends right before a block
    b = blocks.withColumn("second", F.explode(F.sequence(F.floor((F.col("start_us") - lead_us) / SECOND), F.floor(F.col("start_us") / SECOND)))).select("source_id", "block_no", "second", F.col("start_us").alias("b_start"), "voices")
    p = s.withColumn("second", F.floor(F.col("end_us") / SECOND))
    last = b.join(p, ["source_id", "second"]).where((F.col("b_start") - F.col("end_us")).between(0, lead_us)).groupBy("source_id", "block_no").agg(F.max_by(F.struct("pos", "segment_id", "start_us", "text", "voice", "selling", "eligibility", "reported"), "pos").alias("lead"))
    j = blocks.join(last, ["source_id", "block_no"], "left")
    other = F.col("lead.voice").isNotNull() & (F.size("voices") > 0) & ~F.array_contains("voices", F.col("lead.voice"))
    takes = F.coalesce((F.size("lead.selling") >= 2) & (F.col("lead.eligibility") != "excluded") & ~F.col("lead.reported") & ~other, F.lit(False))
    lead_row = F.struct(F.col("lead.pos").alias("pos"), F.col("lead.segment_id").alias("segment_id"), F.col("lead.text").alias("text"))
    j = j.withColumn("rows", F.when(takes, F.concat(F.array(lead_row), "rows")).otherwise(F.col("rows"))).withColumn("start_us", F.when(takes, F.col("lead.start_us")).otherwise(F.col("start_us"))).withColumn("all_signals", F.array_sort(F.when(takes, F.array_union("signals", "lead.selling")).otherwise(F.col("signals"))))
    done = classify_content(spread(j.withColumn("text", F.array_join(F.transform("rows", lambda x: x["text"]), " ")).drop("signals"), "source_id", "block_no"))
    state = F.when(F.col("split"), "review").otherwise(F.col("eligibility"))
    return done.select("source_id", "block_no", "start_us", "end_us", F.array_join(F.transform("rows", lambda x: x["segment_id"]), ",").alias("segment_ids"), F.array_join("all_signals", ",").alias("signals"), state.alias("state"))


def commercial_risk(df: DataFrame) -> DataFrame:
    """Adds state and reasons from a candidate's evidence: eligibility, speech_eligibility, reported, review_reason, audio_signals, visual_signals, gc_kinds, persistent, requested, measured, failed; also the share of frames that were measured."""
    promotion = F.array_intersect("visual_signals", F.array(*map(F.lit, ("discount", "price", "sales_cta", "sponsor", "qr", "installment"))))
    df = df.withColumn("promotion", promotion).withColumn("sampling_coverage", F.round(F.try_divide(F.col("measured").cast("double"), F.nullif("requested", F.lit(0)).cast("double")), 6))
    coverage = F.when((F.col("failed") > 0) & (F.col("measured") > 0), "partially_failed").when(F.col("measured") > 0, "sampled").otherwise("not_measured")
    df = df.withColumn("coverage_state", coverage)
    graphic = F.arrays_overlap("gc_kinds", F.array(*map(F.lit, ("qr", "qr_code", "sponsor", "vinheta", "institutional_promo"))))
    spoken = F.arrays_overlap("audio_signals", F.array(*map(F.lit, ("sales_cta", "sponsor", "discount"))))
    out = F.col("eligibility") == "excluded"
    multimodal = F.col("persistent") & (F.size("promotion") >= 2) & (F.size("gc_kinds") > 0) & spoken & ~F.col("reported")
    cases = [
        (out & (F.col("speech_eligibility") == "excluded"), "confirmed_ad", "grounded_commercial_exclusion"),
        (out, "requires_review", "upstream_exclusion_unconfirmed"),
        (multimodal, "probable_ad", "multimodal_promotion"),
        ((F.col("eligibility") == "review") | (F.size("promotion") > 0) | graphic, "requires_review", None),
        (coverage == "partially_failed", "requires_review", "ocr_partial_failure"),
        (coverage == "sampled", "measured_no_ad_evidence", "no_ad_evidence_in_samples"),
    ]
    pick = lambda k, last: reduce(lambda c, x: c.when(x[0], F.lit(x[k])), cases, F).otherwise(last)
    named = lambda mark, xs: F.transform(xs, lambda x: F.concat(F.lit(mark), x))
    heard = F.array_intersect("audio_signals", F.array(*map(F.lit, SALE_SIGNALS)))
    more = F.array_compact(F.array(F.when(F.size("gc_kinds") > 0, "gc_observed"), F.when(F.col("persistent"), "repeated_ocr_samples"), F.col("review_reason"), pick(2, "visual_not_measured")))
    return df.withColumn("state", pick(1, "not_measured")).withColumn("reasons", F.array_sort(F.array_distinct(F.concat(named("ocr_", F.col("promotion")), named("asr_", heard), more)))).drop("promotion")


def commercial_benchmark(risks: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: how many labelled ads there are, how many of them no risk state caught, how many were not measured; without labels all null."""
    ads = labels.where("expected_ad").select("candidate_id").distinct()
    j = ads.join(risks.select("candidate_id", "state"), "candidate_id", "left")
    missed = F.count_if(F.col("state").isNotNull() & ~F.col("state").isin("confirmed_ad", "probable_ad", "requires_review"))
    unmeasured = F.count_if(F.col("state").isNull())
    n = F.count(F.lit(1))
    return j.agg(F.nullif(n, F.lit(0)).alias("labelled_ads"), F.when((n > 0) & (unmeasured == 0), missed).alias("false_negatives"), F.when(n > 0, unmeasured).alias("unmeasured"))


def apply_commercial(candidates: DataFrame, overlay: DataFrame, k: int = 12, least: float = 0.5) -> DataFrame:
    """Candidates ranked anew: those in excluded blocks leave, those under review are marked and lose half of their score; rank and shortlist of the k best with `least` or more.

    overlay: source_id, moment_id, state (see commercial_overlay).
    """
    j = candidates.join(overlay.select("source_id", "moment_id", "state"), ["source_id", "moment_id"], "left").withColumn("state", F.coalesce("state", F.lit("eligible")))
    j = j.withColumn("new_score", F.round(F.when(F.col("state") == "review", F.col("score") * 0.5).otherwise(F.col("score")), 6))
    w = Window.partitionBy("source_id").orderBy((F.col("state") == "excluded").cast("int"), F.col("new_score").desc_nulls_last(), "moment_id")
    rank = F.when(F.col("state") != "excluded", F.row_number().over(w))
    j = j.withColumn("rank", rank)
    return j.withColumn("shortlisted", F.coalesce((F.col("rank") <= k) & (F.col("new_score") >= least) & (F.col("state") == "eligible"), F.lit(False))).withColumn("gate_reason", F.when(F.col("state") == "excluded", "commercial_block").when(F.col("state") == "review", "commercial_review").when(~F.col("shortlisted"), "rank_or_score"))


# ---------------------------------------------------------------- interest and housekeeping

# Literal requests, cues of interest, closing words, and what marks a request as reported or negated.
REQUESTS = (
    ("subscription_request", r"\b(?:se\s+inscrev[ae]|inscrev[ae]-se)\b"),
    ("comment_request", r"\bcoment[ae](?:m)?\b"),
    ("like_request", r"\b(?:deix[ae]\s+(?:o\s+seu\s+)?like|curt[ae]\s+(?:o\s+)?video)\b"),
    ("share_request", r"\bcompartilh[ae](?:m)?\b"),
)
INTEREST = (
    ("story_cue", r"\b(?:tem\s+uma\s+historia|um\s+dia|uma\s+vez|lembro|lembra|tentei|aconteceu)\b"),
    ("contrast_or_surprise_cue", r"\b(?:achei\s+que\s+era|pensei\s+que|mas\s+na\s+verdade|nao\s+era\s+isso)\b"),
    ("experience_cue", r"\b(?:fico\s+nervos[ao]|fiquei\s+nervos[ao]|me\s+sinto|pela\s+primeira\s+vez|primeiro\s+video)\b"),
)
CLOSING = r"\b(?:ate\s+o\s+proximo\s+episodio|beijo[, ]+tchau|obrigad[ao]|despedida)\b"
SAID = r"\b(?:disse|falou|falava|pediu|pedia|frase|exemplo)\b[^.!?]*$"
NEVER = r"\b(?:nao|nunca)\s*$"


def editorial_potential(df: DataFrame, text: str = "text", context: str | None = None) -> DataFrame:
    """Adds requests (kinds that are asked for directly), interests and potential: requests alone, mixed with interest, content to review, or unresolved. It grants nothing."""
    low = folded(F.col(text))
    after = folded(F.col(context)) if context else F.lit("")
    direct = lambda p: scan(low, p, F.lit(False), lambda s, at, m: s | ~(before(low, at, 100).rlike(sql_pattern(SAID)) | before(low, at, 100).rlike(sql_pattern(NEVER))))
    df = df.withColumn("requests", F.array_compact(F.array(*(F.when(direct(p), F.lit(k)) for k, p in REQUESTS)))).withColumn("interests", F.array_compact(F.array(*(F.when(low.rlike(sql_pattern(p)), F.lit(k)) for k, p in INTEREST))))
    closing = low.rlike(sql_pattern(CLOSING)) | after.rlike(sql_pattern(CLOSING))
    house = (F.size("requests") >= 2) | ((F.size("requests") > 0) & closing)
    interest = F.size("interests") > 0
    return df.withColumn("potential", F.when(house & interest, "MIXED_CTA_CONTENT").when(house, "CTA_HOUSEKEEPING").when(interest, "CONTENT_REVIEW").otherwise("UNRESOLVED")).withColumn("interest_state", F.when(F.col("potential").isin("CONTENT_REVIEW", "MIXED_CTA_CONTENT"), "INTERESTING_CANDIDATE").when(F.col("potential") == "UNRESOLVED", "INTEREST_UNRESOLVED").otherwise("HOUSEKEEPING_REVIEW"))
