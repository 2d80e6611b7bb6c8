"""Windows to annotate over events: their kinds are reasons, seven groups of users are sources, a day passes in 24 minutes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import goldset as op
from ..sources import derived as d
from .registry import Register

_R = Register()
QUERIES, ORACLES, query = _R.queries, _R.oracles, _R.query

_MOST, _WIDTH = 16, 4_000_000


def reasons(spark, sf_dir):
    """source_id, reason, time_us, and source_id, duration_us."""
    e = d.table(spark, sf_dir, "events")
    t = e.select((F.col("user_id") % 7).alias("source_id"), F.when(F.col("value") < 1, F.lit(None)).otherwise(F.col("event_type")).alias("reason"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) % 86400000000 div 60").alias("time_us"))
    n = t.groupBy("source_id").agg((F.col("source_id") * 200_000_000 + 30_000_000).alias("duration_us"))
    return t, n


@query(f"""with recursive t as (select user_id % 7 as source_id, case when value < 1 then 'unknown' else event_type end as reason, epoch_us(ts) % 86400000000 // 60 as time_us from events), du as (select source_id, source_id * 200000000 + 30000000 as duration_us from t group by 1),
 u as (select distinct source_id, reason, time_us, duration_us from t join du using (source_id) where time_us >= 0 and time_us < duration_us), r as (select *, row_number() over (partition by source_id, reason order by time_us) - 1 as p, count(*) over (partition by source_id, reason) as n from u),
 k as (select *, case when p % 2 = 0 then p // 2 else (n + 1) // 2 + n // 2 - 1 - (p - 1) // 2 end as turn, greatest(least(time_us - {_WIDTH // 2}, duration_us - {_WIDTH}), 0) as start_us from r),
 o as (select *, least(duration_us, start_us + {_WIDTH}) as end_us, row_number() over (partition by source_id order by turn, reason, start_us) as i from k),
 g as (select source_id, 0::bigint as i, []::struct(s bigint, e bigint, reason varchar)[] as picks from o group by 1 union all
  select g.source_id, o.i, case when len(list_filter(g.picks, lambda x: greatest(x.s, o.start_us) < least(x.e, o.end_us))) = 0 then list_append(g.picks, {{'s': o.start_us, 'e': o.end_us, 'reason': o.reason}}) else g.picks end from g join o on o.source_id = g.source_id and o.i = g.i + 1 where len(g.picks) < {_MOST}),
 z as (select source_id, arg_max(picks, i) as picks from g group by 1), x as (select source_id, len(picks) as n, unnest(picks) as p from z)
 select source_id, (row_number() over (partition by source_id order by p.s, p.e, p.reason))::int as sample_no, p.s as start_us, p.e as end_us, p.reason as reason, case when n < 10 then 'PARTIAL' else 'READY_FOR_REVIEW' end as status from x""")
def t10_goldset_windows(spark, sf_dir):
    return op.goldset_windows(*reasons(spark, sf_dir), most=_MOST, window_us=_WIDTH)
