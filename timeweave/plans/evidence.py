"""Text evidence over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import evidence as op
from ..sources import derived as d
from .registry import Register

_R = Register()
QUERIES, ORACLES, query = _R.queries, _R.oracles, _R.query

_STOP = ", ".join(f"'{w}'" for w in t.STOP_WORDS)
_FOLD = f"translate(lower(text), '{t.ACCENTED}', '{t.PLAIN}')"
_TOKENS = f"regexp_extract_all({_FOLD}, '[a-z0-9]+')"
_TERMS = f"list_sort(list_distinct(list_filter({_TOKENS}, lambda x: length(x) >= 3 and x not in ({_STOP}))))"


def docs(spark, sf_dir):
    return d.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


@query(f"select doc_id, md5({_FOLD}) as folded from documents")
def f1_fold_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(t.fold(F.col("text"))).alias("folded"))


@query(f"select doc_id, len({_TOKENS}) as n_tokens, md5(array_to_string({_TOKENS}, ' ')) as lexical from documents")
def f2_lexical_text(spark, sf_dir):
    k = t.tokens(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(k).cast("long").alias("n_tokens"), F.md5(F.array_join(k, " ")).alias("lexical"))


@query(f"select doc_id, len({_TERMS}) as n_terms, md5(array_to_string({_TERMS}, ' ')) as terms from documents")
def f3_terms(spark, sf_dir):
    k = t.terms(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(k).cast("long").alias("n_terms"), F.md5(F.array_join(k, " ")).alias("terms"))


_FAMILIES = " ".join(f"when regexp_matches(x, '{p}') then '{r}'" for r, p in t.FAMILIES)
_STEM = "case when length(x) < 5 then x " + " ".join(f"when ends_with(x, '{s}') and length(x) - {len(s)} >= 4 then left(x, length(x) - {len(s)})" for s in t.SUFFIXES) + " else x end"


@query(f"select doc_id, len(k) as n_terms, md5(array_to_string(k, ' ')) as terms, md5(array_to_string(z, ' ')) as stems from (select doc_id, list_sort(list_distinct(list_transform({_TERMS}, lambda x: case {_FAMILIES} else x end))) as k, list_transform({_TOKENS}, lambda x: {_STEM}) as z from documents)")
def f3_stem(spark, sf_dir):
    e = docs(spark, sf_dir).select("doc_id", t.qa_terms(F.col("text")).alias("k"), F.transform(t.tokens(F.col("text")), t.stem).alias("z"))
    return e.select("doc_id", F.size("k").cast("long").alias("n_terms"), F.md5(F.array_join("k", " ")).alias("terms"), F.md5(F.array_join("z", " ")).alias("stems"))


@query("select page_id, sha256(page_id || '|' || coalesce(url, '') || '|' || coalesce(html, '')) as digest from pages")
def f6_digest(spark, sf_dir):
    p = d.table(spark, sf_dir, "pages")
    return p.select("page_id", F.sha2(F.concat_ws("|", "page_id", F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))), 256).alias("digest"))


@query(r"""with s as (select doc_id, unnest(l) as s, unnest(range(len(l))) as pos from (select doc_id, regexp_extract_all(text, '[^.!?\n]+[.!?]') as l from documents)), f as (select doc_id, pos, trim(s) as s from s where length(trim(s)) between 2 and 100 and len(regexp_split_to_array(trim(s), ' +')) <= 14)
 select doc_id, rank::int as rank, s as sentence from (select *, row_number() over (partition by doc_id order by pos) as rank from f) where rank <= 4""")
def f8_sentences(spark, sf_dir):
    return op.sentences(docs(spark, sf_dir), "doc_id")


@query(r"""with u as (select page_id, case page_id % 4 when 0 then 'https://www.youtube.com/watch?v=' || substr(md5(url), 1, 11) || '&t=3' when 1 then 'https://youtu.be/' || substr(md5(url), 1, 11) when 2 then 'https://evil.example/watch?v=' || substr(md5(url), 1, 11) else url end as link from pages)
 select page_id, nullif(regexp_extract(link, '^https?://(?:www\.|m\.)?(?:youtube\.com/(?:watch\?(?:[^#]*&)?v=|embed/|shorts/)|youtu\.be/)([A-Za-z0-9_-]{11})(?:[?&#/].*)?$', 1), '') as video_id from u""")
def f11_video_id(spark, sf_dir):
    code = F.substring(F.md5("url"), 1, 11)
    kind = F.col("page_id") % 4
    link = F.when(kind == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), code, F.lit("&t=3"))).when(kind == 1, F.concat(F.lit("https://youtu.be/"), code)).when(kind == 2, F.concat(F.lit("https://evil.example/watch?v="), code)).otherwise(F.col("url"))
    return d.table(spark, sf_dir, "pages").select("page_id", t.video_id(link).alias("video_id"))


def _private(name: str, pattern: str) -> str:
    return f"select doc_id, '{name}' as rule, regexp_extract_all(text, '{pattern}') as l from documents"


@query("with f as (" + " union all ".join(_private(*c) for c in t.PRIVATE.items()) + ") select doc_id, rule, k, length(v)::int as length, sha256(v) as sha256 from (select doc_id, rule, unnest(range(len(l)))::int as k, unnest(l) as v from f)")
def n9_private_findings(spark, sf_dir):
    return op.private_findings(docs(spark, sf_dir), "doc_id")


def _redacted() -> str:
    x = "text"
    for name, pattern in t.PRIVATE.items():
        x = f"regexp_replace({x}, '{pattern}', '[{name}]', 'g')"
    return x


@query(f"select doc_id, md5({_redacted()}) as redacted, {_redacted()} <> text as changed from documents")
def n10_redact(spark, sf_dir):
    r = t.redact(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.md5(r).alias("redacted"), (r != F.col("text")).alias("changed"))


_METHODS = ("tesseract_keyframe", "tesseract_candidate_frame_s8", "legacy_hint", "manual")


@query(f"""with r as (select doc_id, text, case when doc_id % 23 = 22 then null else doc_id * 1.5::double - 3 end as observed_at, {list(_METHODS)}[(doc_id % 4 + 1)::int] as method, case when doc_id % 9 = 8 then 'not_measured' end as state, doc_id % 7 = 6 as by_hand from documents), m as (select *, method in ('tesseract_keyframe', 'tesseract_candidate_frame_s8') and coalesce(state, '') <> 'not_measured' and not by_hand as measured from r where observed_at >= 0)
 select doc_id, observed_at, measured, case when measured then md5(coalesce(text, '')) end as original_text, case when measured then md5(trim(regexp_replace(lower(coalesce(text, '')), '[ \\t\\n\\r]+', ' ', 'g'))) end as normalized_text from m""")
def n12_normalize_text(spark, sf_dir):
    i = F.col("doc_id")
    r = docs(spark, sf_dir).select("doc_id", "text", F.when(i % 23 != 22, i * 1.5 - 3).alias("observed_at"), F.array(*map(F.lit, _METHODS))[(i % 4).cast("int")].alias("method"), F.when(i % 9 == 8, "not_measured").alias("state"), (i % 7 == 6).alias("by_hand"))
    return op.normalize_ocr(r).select("doc_id", "observed_at", "measured", F.md5("original_text").alias("original_text"), F.md5("normalized_text").alias("normalized_text"))


@query(f"""with k as (select doc_id, unnest(l) as term, unnest(range(len(l))) as pos from (select doc_id, {_TOKENS} as l from documents)), n as (select doc_id, term, count(*) as n, min(pos) as first from k where length(term) >= 3 and term not in ({_STOP}) group by 1, 2)
 select doc_id, rank::int as rank, term, n from (select *, row_number() over (partition by doc_id order by n desc, first, term) as rank from n) where rank <= 5""")
def b33_topic_keywords(spark, sf_dir):
    return op.topic_keywords(docs(spark, sf_dir), "doc_id")


@query("""with c as (select b.item_id as claim_id, b.text || ' ' || (b.item_id * 7) as claim, d.text || ' ' || (d.doc_id * 7) as source_text, substr(d.text, 3, 20) || case when d.doc_id % 2 = 0 then '' else '#' end as quote from benchmark b join documents d on d.doc_id = b.item_id)
 select claim_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(claim, '[0-9]+')), lambda x: not list_contains(regexp_extract_all(source_text, '[0-9]+'), x))), ',') as unsupported, contains(source_text, quote) as literal from c""")
def c18_claim_check(spark, sf_dir):
    b, x = d.table(spark, sf_dir, "benchmark").withColumnRenamed("text", "said"), docs(spark, sf_dir)
    c = b.join(x, F.col("item_id") == F.col("doc_id")).select(F.col("item_id").alias("claim_id"), F.concat("said", F.lit(" "), F.col("item_id") * 7).alias("claim"), F.concat("text", F.lit(" "), F.col("doc_id") * 7).alias("source_text"), F.concat(F.substring("text", 3, 20), F.when(F.col("doc_id") % 2 == 0, "").otherwise("#")).alias("quote"))
    return op.claim_check(c)


_SEGTERMS = f"(select source_id, turn, {_TERMS} as t from segments)"


@query(f"""select source_id, turn, round(case when p is not null and u > 0 then i / u end, 6) as similarity from (select source_id, turn, p, len(list_intersect(t, p)) as i, len(list_distinct(list_concat(t, p))) as u from (select *, lag(t) over (partition by source_id order by turn) as p from {_SEGTERMS}))""", "segments")
def a17_topic_similarity(spark, sf_dir):
    s = d.segments(spark, sf_dir).withColumn("terms", t.terms(F.col("text")))
    return op.pair_similarity(s, "turn", "source_id", "terms")


@query(f"""with s as (select source_id, turn, speaker, t from (select *, {_TERMS} as t from segments)) select q.source_id, q.turn as question, a.turn as answer, len(list_intersect(q.t, a.t)) as shared from s q join s a on a.source_id = q.source_id and q.speaker = 'user' and a.speaker <> 'user' and a.turn between q.turn + 1 and q.turn + 6 and len(list_intersect(q.t, a.t)) >= 2
 qualify row_number() over (partition by q.source_id, q.turn order by shared desc, a.turn) <= 4""".replace("with s as", ", s as", 1), "segments")
def j12_forward_links(spark, sf_dir):
    s = d.segments(spark, sf_dir).withColumn("t", t.terms(F.col("text"))).select("source_id", "turn", "speaker", "t")
    q = s.where("speaker = 'user'").select("source_id", F.col("turn").alias("question"), F.col("t").alias("q"))
    a = s.where("speaker <> 'user'").select("source_id", F.col("turn").alias("answer"), F.col("t").alias("a"))
    # an answer is looked for at each of the next six places: an equi-join on the place
    asked = q.withColumn("answer", F.explode(F.expr("sequence(question + 1, question + 6)")))
    j = asked.join(a, ["source_id", "answer"]).withColumn("shared", F.size(F.array_intersect("q", "a")).cast("long")).where("shared >= 2")
    w = Window.partitionBy("source_id", "question").orderBy(F.col("shared").desc(), "answer")
    return j.withColumn("k", F.row_number().over(w)).where("k <= 4").select("source_id", "question", "answer", "shared")


@query("""select segment_id, lower(substr(ltrim(text), 1, 1)) = substr(ltrim(text), 1, 1) or regexp_matches(lower(text), '^(?:and|but|et|und|or) ') as dangling, regexp_matches(text, '[.?!]\\s*$') and not regexp_matches(lower(text), '\\b(?:and|et|und)[.?!]?\\s*$') as clean_ending from segments""", "segments")
def n18_opening_ending(spark, sf_dir):
    first = F.substring(F.ltrim("text"), 1, 1)
    low = F.lower("text")
    return d.segments(spark, sf_dir).select("segment_id", ((F.lower(first) == first) | low.rlike("^(?:and|but|et|und|or) ")).alias("dangling"), (F.col("text").rlike(t.sql_pattern(r"[.?!]\s*$")) & ~low.rlike(t.sql_pattern(r"\b(?:and|et|und)[.?!]?\s*$"))).alias("clean_ending"))


@query("""select doc_id, case when length(text) <= 300 then text else regexp_replace(substr(text, 1, 300), '[ \\n]+[^ \\n]*\\z', '') end as quote, substr(sha256(text), 1, 16) as reference from documents where length(text) > 0""")
def t16_quote_catalog(spark, sf_dir):
    q = F.when(F.length("text") <= 300, F.col("text")).otherwise(F.regexp_replace(F.substring("text", 1, 300), r"[ \n]+[^ \n]*\z", ""))
    return docs(spark, sf_dir).where(F.length("text") > 0).select("doc_id", q.alias("quote"), F.substring(F.sha2("text", 256), 1, 16).alias("reference"))


@query(r"""with e as (select doc_id, unnest(regexp_extract_all(text, '(?:^|[ \n])([A-Z][a-z]{2,})', 1)) as name from documents), n as (select name, count(*) as mentions, count(distinct doc_id) as n_docs, min(doc_id) as first_doc from e group by 1)
 select a.name, a.mentions, a.n_docs, a.first_doc, case when count(b.name) = 1 then min(b.name) end as alias_of from n a left join n b on length(b.name) > length(a.name) and starts_with(b.name, a.name) group by 1, 2, 3, 4""")
def b32_entities(spark, sf_dir):
    return op.entities(docs(spark, sf_dir), r"(?:^|[ \n])([A-Z][a-z]{2,})")
