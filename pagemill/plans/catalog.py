"""All registered queries and their oracles: the engine's operators on the tables of one folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions import arrays, keys, text
from pagemill.operators import intervals, jobs, samples, summaries
from pagemill.sources.tables import table
from pagemill.streaming.append import append_once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Parameters of the registered queries.
N_VAL, SHARD_ROWS, PACK_CHARS, RESAMPLES = 200, 400, 300_000, 1000
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def query(sql: str | None = None):
    """Register a function under its name, with its oracle."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# Summaries


@query("""
WITH m AS (SELECT event_type, user_id, count(value) AS n, sum(value) AS total FROM events GROUP BY ALL),
b AS (SELECT user_id, total / n AS base FROM m WHERE event_type = 'click')
SELECT event_type AS method, sum(n)::BIGINT AS n, round(sum(total) / sum(n), 6) AS mean_value,
  round(avg(CASE WHEN event_type <> 'click' THEN total / n - base END), 6) AS gain_vs_input
FROM m LEFT JOIN b USING (user_id) GROUP BY event_type""")
def method_summary(spark, d):
    out = summaries.method_summary(table(spark, d, "events"), "event_type", "user_id", "value", "click")
    return out.select("method", "n", r6("mean_value").alias("mean_value"), r6("gain_vs_input").alias("gain_vs_input"))


@query("""
WITH g AS (SELECT l_returnflag AS method, printf('{"discount": %.2f, "tax": %.2f}', l_discount, l_tax) AS params, count(*) AS n, round(avg(l_extendedprice), 6) AS mean_price FROM lineitem GROUP BY ALL)
SELECT method, params, n, mean_price FROM g QUALIFY row_number() OVER (PARTITION BY method ORDER BY mean_price DESC, params) = 1""")
def tune_best(spark, d):
    params = F.format_string('{"discount": %.2f, "tax": %.2f}', "l_discount", "l_tax")
    grouped = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("method"), params.alias("params")).agg(F.count("*").alias("n"), r6(F.avg("l_extendedprice")).alias("mean_price"))
    best = F.row_number().over(Window.partitionBy("method").orderBy(F.desc("mean_price"), "params"))
    return grouped.withColumn("place", best).filter("place = 1").drop("place")


@query("""
SELECT o_orderpriority, count(*) AS n, round(quantile_cont(o_totalprice, 0.05), 2) AS q05, round(quantile_cont(o_totalprice, 0.25), 2) AS q25,
  round(quantile_cont(o_totalprice, 0.5), 2) AS q50, round(quantile_cont(o_totalprice, 0.75), 2) AS q75, round(quantile_cont(o_totalprice, 0.95), 2) AS q95
FROM orders GROUP BY 1""")
def profile_quantiles(spark, d):
    qs = [F.round(F.expr(f"percentile(o_totalprice, {q / 100})"), 2).alias(f"q{q:02d}") for q in (5, 25, 50, 75, 95)]
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), *qs)


@query("""
SELECT n_name || ' / ' || c_mktsegment AS kind, count(*) AS n, count(*) FILTER (WHERE c_acctbal > 0) AS n_positive, count(DISTINCT c_custkey) AS n_distinct,
  round(median(c_acctbal), 6) AS median_balance, round(quantile_cont(c_acctbal, 0.9), 6) AS p90_balance
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def composite_counts(spark, d):
    facts = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return facts.groupBy(F.concat_ws(" / ", "n_name", "c_mktsegment").alias("kind")).agg(
        F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("n_positive"), F.countDistinct("c_custkey").alias("n_distinct"),
        r6(F.median("c_acctbal")).alias("median_balance"), r6(F.expr("percentile(c_acctbal, 0.9)")).alias("p90_balance"),
    )


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


@query("SELECT lang, source, count(*) AS n, round(avg(quality), 6) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def success_rates(spark, d):
    return labelled(spark, d).groupBy("lang", "source").agg(F.count("*").alias("n"), r6(F.avg("quality")).alias("rate"))


@query("""
SELECT l_returnflag AS cleaner, stage, count(v) AS n, round(median(v), 6) AS median_value
FROM (SELECT l_returnflag, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (v FOR stage IN (l_quantity, l_discount, l_tax)) GROUP BY ALL""")
def stage_medians(spark, d):
    columns = ["l_quantity", "l_discount", "l_tax"]
    long = table(spark, d, "lineitem").unpivot(["l_returnflag"], columns, "stage", "v").filter("v is not null")
    return long.groupBy(F.col("l_returnflag").alias("cleaner"), "stage").agg(F.count("v").alias("n"), r6(F.median("v")).alias("median_value"))


@query("""
SELECT lang, round(sum(toxic * n_chars)::DOUBLE / greatest(sum(n_chars), 1), 6) AS pooled, round(avg(toxic), 6) AS plain
FROM labels JOIN documents USING (doc_id) WHERE n_chars > 0 GROUP BY lang""")
def pooled_rate(spark, d):
    pooled = F.sum(F.col("toxic") * F.col("n_chars")) / F.greatest(F.sum("n_chars"), F.lit(1))
    return labelled(spark, d).filter("n_chars > 0").groupBy("lang").agg(r6(pooled).alias("pooled"), r6(F.avg("toxic")).alias("plain"))


def length_class(n: Column) -> Column:
    return F.when(n < 500, "short").when(n <= 2000, "middle").otherwise("long")


@query("""
WITH f AS (SELECT lang, source, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars <= 2000 THEN 'middle' ELSE 'long' END AS length, quality FROM labels JOIN documents USING (doc_id))
SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'length' END AS dimension, coalesce(lang, source, length) AS level,
  count(quality) AS n, round(avg(quality), 6) AS mean_quality FROM f GROUP BY GROUPING SETS ((lang), (source), (length))""")
def grouping_sets_breakdown(spark, d):
    facts = labelled(spark, d).withColumn("length", length_class(F.col("n_chars")))
    return summaries.breakdown(facts, ["lang", "source", "length"], "quality").select("dimension", "level", "n", r6("mean").alias("mean_quality"))


@query("""
SELECT lang, round(avg(quality) FILTER (WHERE n_chars < 500), 6) AS short, round(avg(quality) FILTER (WHERE n_chars BETWEEN 500 AND 2000), 6) AS middle,
  round(avg(quality) FILTER (WHERE n_chars > 2000), 6) AS long FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def breakdown_pivot(spark, d):
    facts = labelled(spark, d).withColumn("length", length_class(F.col("n_chars")))
    wide = facts.groupBy("lang").pivot("length", ["short", "middle", "long"]).agg(F.avg("quality"))
    return wide.select("lang", *(r6(c).alias(c) for c in ("short", "middle", "long")))


def user_means(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("method"), "user_id").agg(r6(F.avg("value")).alias("v"))


_BOOTSTRAP = f"""
picked AS (SELECT method, r, v, {intervals.DRAWS_SQL} AS w FROM (SELECT method, user_id % {intervals.PRIME} AS k, v FROM u), range(1, {RESAMPLES + 1}) t(r)),
means AS (SELECT method, r, sum(w * v) / nullif(sum(w), 0) AS m FROM picked GROUP BY ALL),
ci AS (SELECT method, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM means GROUP BY 1)
SELECT method, count(*) AS n, round(avg(v), 6) AS mean, any_value(lo) AS lo, any_value(hi) AS hi, any_value(lo > 0 OR hi < 0) AS excludes_zero FROM u JOIN ci USING (method) GROUP BY method"""


def _interval_columns(out: DataFrame) -> DataFrame:
    rounded = out.select("method", "n", r6("mean").alias("mean"), r6("lo").alias("lo"), r6("hi").alias("hi"))
    return rounded.withColumn("excludes_zero", (F.col("lo") > 0) | (F.col("hi") < 0))


@query("WITH u AS (SELECT event_type AS method, user_id, round(avg(value), 6) AS v FROM events GROUP BY ALL)," + _BOOTSTRAP)
def bootstrap_ci_native(spark, d):
    return _interval_columns(intervals.bootstrap(user_means(spark, d), ["method"], F.col("user_id"), "v", RESAMPLES))


@query()
def bootstrap_ci_exact(spark, d):
    return _interval_columns(summaries.bootstrap_exact(user_means(spark, d), "method", "user_id", "v"))


@query("""WITH k AS (SELECT event_type, user_id, round(avg(value), 6) AS v FROM events GROUP BY ALL),
u AS (SELECT 'click - view' AS method, user_id, round(a.v - b.v, 6) AS v FROM k a JOIN k b USING (user_id) WHERE a.event_type = 'click' AND b.event_type = 'view'),""" + _BOOTSTRAP)
def paired_bootstrap(spark, d):
    means = user_means(spark, d)
    a, b = (means.filter(F.col("method") == m).select("user_id", F.col("v").alias(c)) for m, c in (("click", "a"), ("view", "b")))
    differences = a.join(b, "user_id").select(F.lit("click - view").alias("method"), "user_id", r6(F.col("a") - F.col("b")).alias("v"))
    return _interval_columns(intervals.bootstrap(differences, ["method"], F.col("user_id"), "v", RESAMPLES))


@query("""
WITH r AS (SELECT event_type AS label, strftime(ts, '%Y-%m-%d') AS job, (count(*) // 10)::BIGINT AS n, round(max(value), 6) AS psnr,
  CASE WHEN day(ts) % 3 = 0 THEN round(min(value), 6) END AS lpips FROM events GROUP BY event_type, strftime(ts, '%Y-%m-%d'), day(ts)),
k AS (SELECT * FROM r QUALIFY n = max(n) OVER (PARTITION BY label))
SELECT label, max(n) AS n, max(job) AS job, arg_max(psnr, job) FILTER (WHERE psnr IS NOT NULL) AS psnr, arg_max(lpips, job) FILTER (WHERE lpips IS NOT NULL) AS lpips FROM k GROUP BY label""")
def merge_newest_wins(spark, d):
    day = F.date_format("ts", "yyyy-MM-dd")
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("label"), day.alias("job")).agg(F.floor(F.count("*") / 10).alias("n"), r6(F.max("value")).alias("psnr"), r6(F.min("value")).alias("least"))
    rows = rows.withColumn("lpips", F.when(F.day(F.to_date("job")) % 3 == 0, F.col("least")))
    return summaries.newest_wins(rows, "label", "job", "n", ["psnr", "lpips"])


@query("""SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id""")
def latest_event(spark, d):
    last = F.max(F.struct("ts", "event_id", "event_type")).alias("last")
    return table(spark, d, "events").groupBy("user_id").agg(last).select("user_id", "last.ts", "last.event_id", "last.event_type")


# Samples


def turns(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "conversations")
    user = rows.filter("role = 'user'").groupBy("conv_id", "turn").agg(F.max("text").alias("ask"))
    reply = rows.filter("role = 'assistant'").groupBy("conv_id", (F.col("turn") - 1).alias("turn")).agg(F.max("text").alias("reply"))
    return user, reply


_PAIRS = """
WITH u AS (SELECT conv_id, turn, max(text) AS ask FROM conversations WHERE role = 'user' GROUP BY ALL), a AS (SELECT conv_id, turn - 1 AS turn, max(text) AS reply FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn),
p AS (SELECT conv_id, turn, CASE WHEN reply IS NULL THEN 'no reply' WHEN ask IS NULL THEN 'no ask' END AS problem, length(ask) AS ask_chars, length(reply) AS reply_chars FROM u FULL JOIN a USING (conv_id, turn))
"""


@query(_PAIRS + "SELECT * FROM p")
def pair_discovery(spark, d):
    pairs = samples.paired(*turns(spark, d), ["conv_id", "turn"], ("ask", "reply"))
    return pairs.select("conv_id", "turn", "problem", F.length("ask").cast("bigint").alias("ask_chars"), F.length("reply").cast("bigint").alias("reply_chars"))


@query(_PAIRS + "SELECT conv_id, turn, problem FROM p WHERE problem IS NOT NULL")
def pair_problems(spark, d):
    return samples.paired(*turns(spark, d), ["conv_id", "turn"], ("ask", "reply")).filter("problem is not null").select("conv_id", "turn", "problem")


@query("""SELECT l_orderkey, max(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS a_price, max(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS r_price
FROM lineitem GROUP BY 1 HAVING a_price IS NOT NULL AND r_price IS NOT NULL""")
def complete_samples(spark, d):
    wide = table(spark, d, "lineitem").groupBy("l_orderkey").pivot("l_returnflag", ["A", "R"]).agg(F.max("l_extendedprice")).dropna()
    return wide.select("l_orderkey", F.col("A").alias("a_price"), F.col("R").alias("r_price"))


_SEED = "('0x' || substr(sha1('{salt}:' || doc_id), 1, 15))::BIGINT"


@query(f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_SEED.format(salt='val')}, doc_id) <= {N_VAL} THEN 'val' ELSE 'train' END AS split FROM documents")
def split_train_val(spark, d):
    ids = table(spark, d, "documents").select("doc_id")
    val = samples.held_out(ids, "doc_id", N_VAL, "val")
    return val.withColumn("split", F.lit("val")).unionByName(ids.join(val, "doc_id", "left_anti").withColumn("split", F.lit("train")))


@query(f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_SEED.format(salt="corpus")}, doc_id) AS k, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN k <= round_even(0.8 * n, 0) THEN 'train' WHEN k <= round_even(0.8 * n, 0) + round_even(0.1 * n, 0) THEN 'val' ELSE 'test' END AS split FROM r""")
def split_80_10_10(spark, d):
    return samples.shares_split(table(spark, d, "documents").select("doc_id"), "doc_id", "corpus", [("train", 0.8), ("val", 0.1)], "test")


_ASCII = "regexp_replace({x}, '[^ -~\\n]', '', 'g')"
_BULLET_FREE = "array_to_string(list_filter(string_split(trim(regexp_replace({x}, '\\s+', ' ', 'g')), ' '), lambda w: w <> '*' AND w <> ''), ' ')"


def _normal_sql(x: str) -> str:
    return f"lower({_BULLET_FREE.format(x=_ASCII.format(x=x))})"


@query(f"""WITH l AS (SELECT DISTINCT doc_id, {_normal_sql("line")} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
b AS (SELECT DISTINCT item_id, {_normal_sql("line")} AS line FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark))
SELECT item_id, line, count(*) AS n_docs FROM b JOIN l USING (line) WHERE length(line) >= 20 GROUP BY ALL""")
def split_leak_check(spark, d):
    def lines(name: str, key: str) -> DataFrame:
        long = table(spark, d, name).select(key, F.explode(F.split("text", "\n")).alias("line"))
        return long.select(key, text.normalize(text.ascii_only(F.col("line"))).alias("line")).filter(F.length("line") >= 20).distinct()

    return lines("benchmark", "item_id").join(lines("documents", "doc_id"), "line").groupBy("item_id", "line").agg(F.count("*").alias("n_docs"))


def plan_of(spark: SparkSession, d: str) -> DataFrame:
    return samples.shard_plan(table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("size")), "doc_id", SHARD_ROWS)


_SHARDS = f"p AS (SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // {SHARD_ROWS})::BIGINT AS shard, octet_length(encode(text)) AS size FROM documents)"


@query(f"WITH {_SHARDS} SELECT doc_id, shard FROM p")
def shard_plan(spark, d):
    return plan_of(spark, d).select("doc_id", "shard")


@query(f"WITH {_SHARDS} SELECT shard, count(*) AS samples, sum(size)::BIGINT AS bytes FROM p GROUP BY 1")
def manifest_totals(spark, d):
    return samples.manifest(plan_of(spark, d), "doc_id", F.col("size")).drop("sources")


@query(f"""WITH {_SHARDS}, m AS (SELECT shard, count(*) AS samples, list(doc_id ORDER BY doc_id) AS sources FROM p GROUP BY 1)
SELECT shard, samples FROM m WHERE NOT (shard % 2 = 0 AND shard % 4 <> 0)""")
def shards_todo(spark, d):
    """The manifest at hand has the even shards; those divisible by four lack a source."""
    plan = samples.manifest(plan_of(spark, d), "doc_id", F.col("size"))
    done = plan.filter("shard % 2 = 0").withColumn("sources", F.when(F.col("shard") % 4 == 0, F.slice("sources", 2, F.size("sources"))).otherwise(F.col("sources")))
    return samples.unfinished(plan, done).select("shard", "samples")


@query("""SELECT c_custkey, p AS o_orderpriority FROM customer, (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS p)
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = p)""")
def resume_pending(spark, d):
    plan = table(spark, d, "customer").select("c_custkey", F.explode(F.array(*map(F.lit, PRIORITIES))).alias("o_orderpriority"))
    done = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return samples.pending(plan, done, ["c_custkey", "o_orderpriority"])


@query("SELECT n_name AS method, flag, q AS quality FROM nation, (SELECT unnest(['A', 'N', 'R']) AS flag), (SELECT unnest([1, 2, 4]) AS q)")
def grid_expand(spark, d):
    names = table(spark, d, "nation").select(F.col("n_name").alias("method"), F.explode(F.array(*map(F.lit, "ANR"))).alias("flag"))
    return names.withColumn("quality", F.explode(F.array(*map(F.lit, (1, 2, 4)))))


@query(f"""SELECT page_id, size, total FROM (SELECT page_id, length(html) AS size, sum(length(html)) OVER (ORDER BY length(html), page_id ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM pages) WHERE total <= {PACK_CHARS}""")
def running_pack(spark, d):
    files = table(spark, d, "pages").select("page_id", F.length("html").cast("bigint").alias("size"))
    return samples.packed(files, "size", ["page_id"], PACK_CHARS)


@query("""WITH l AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS k FROM
(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents))
SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM l WHERE k = 1 OR length(line) <= 12 GROUP BY 1""")
def dedupe_short_exempt(spark, d):
    """Each line once, but lines of up to 12 characters as often as they come. The first place of a line is a grouped minimum."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    first = lines.filter(F.length("line") > 12).groupBy("line").agg(F.min(F.struct("doc_id", "pos")).alias("at")).select("at.doc_id", "line")
    kept = first.unionByName(lines.filter(F.length("line") <= 12).select("doc_id", "line"))
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("bigint").alias("n_chars"))


@query(f"SELECT doc_id, {_SEED.format(salt='crop')} AS seed, source || '__' || doc_id || '--c1' AS sample_id, source || '/' || doc_id AS key FROM documents")
def stable_seed(spark, d):
    key = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    ids = table(spark, d, "documents").select("doc_id", keys.stable_seed("crop", F.col("doc_id")).alias("seed"), keys.encode_key(key, F.lit(1)).alias("sample_id"))
    return ids.withColumn("key", keys.decode_key(F.col("sample_id")))


# Text


@query(f"SELECT doc_id, {_normal_sql('text')} AS normal FROM documents")
def text_normalize(spark, d):
    """The whole texts' ASCII, as SQL can say it; :func:`text_normalize_whole` keeps all letters."""
    return table(spark, d, "documents").select("doc_id", text.normalize(text.ascii_only(F.col("text"))).alias("normal"))


@query()
def text_normalize_whole(spark, d):
    """Whole texts with all their letters, after compatibility composition."""
    return table(spark, d, "documents").select("doc_id", text.normalize(text.nfkc(F.col("text"))).alias("normal"))


def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring turns as reference and hypothesis: their ASCII, normalised, as SQL can say it (its edit distance counts bytes)."""
    return paired_turns(spark, d, text.normalize(text.ascii_only(F.col("text"))))


def whole_turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring turns as reference and hypothesis, whole and with all their letters."""
    return paired_turns(spark, d, text.normalize(text.nfkc(F.col("text"))))


def paired_turns(spark: SparkSession, d: str, normal: Column) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", normal.alias("ref"))
    later = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ref").alias("hyp"))
    return rows.join(later, ["conv_id", "turn"])


_TURNS = f"""WITH t AS (SELECT conv_id, turn, {_normal_sql("text")} AS x FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.x AS ref, b.x AS hyp FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = b.turn - 1)
"""


@query(_TURNS + "SELECT conv_id, turn, length(ref) AS ref_chars, round(CASE WHEN ref = '' THEN (CASE WHEN hyp = '' THEN 0.0 ELSE 1.0 END)::DOUBLE ELSE levenshtein(ref, hyp)::DOUBLE / length(ref) END, 6) AS cer FROM p")
def cer_pairs(spark, d):
    return turn_pairs(spark, d).select("conv_id", "turn", F.length("ref").cast("bigint").alias("ref_chars"), r6(text.cer(F.col("ref"), F.col("hyp"))).alias("cer"))


@query()
def wer_pairs(spark, d):
    return turn_pairs(spark, d).select("conv_id", "turn", r6(text.wer(F.col("ref"), F.col("hyp"))).alias("wer"))


@query(_TURNS + """, w AS (SELECT conv_id, turn, list_filter(string_split(ref, ' '), lambda x: x <> '') AS r, list_filter(string_split(hyp, ' '), lambda x: x <> '') AS h FROM p)
SELECT conv_id, turn, round(CASE WHEN len(r) + len(h) = 0 THEN 1.0 ELSE 2.0 * coalesce(list_sum(list_transform(list_distinct(r), lambda x: least(len(list_filter(r, lambda y: y = x)), len(list_filter(h, lambda y: y = x))))), 0)::DOUBLE / greatest(len(r) + len(h), 1) END, 6) AS word_f1 FROM w""")
def word_f1_pairs(spark, d):
    return turn_pairs(spark, d).select("conv_id", "turn", r6(text.word_f1(F.col("ref"), F.col("hyp"))).alias("word_f1"))


@query()
def cer_whole(spark, d):
    return whole_turn_pairs(spark, d).select("conv_id", "turn", F.length("ref").cast("bigint").alias("ref_chars"), r6(text.cer(F.col("ref"), F.col("hyp"))).alias("cer"))


@query()
def wer_whole(spark, d):
    return whole_turn_pairs(spark, d).select("conv_id", "turn", r6(text.wer(F.col("ref"), F.col("hyp"))).alias("wer"))


@query()
def word_f1_whole(spark, d):
    return whole_turn_pairs(spark, d).select("conv_id", "turn", r6(text.word_f1(F.col("ref"), F.col("hyp"))).alias("word_f1"))


@query(r"""SELECT lang, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(line, '[(){};=\[\]]|^\s|^(import|def|class|return|for|while|try|except|SELECT|UPDATE|CREATE)\b') AND NOT ends_with(line, '.')) AS n_code
FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY lang""")
def code_line_classify(spark, d):
    lines = table(spark, d, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("lang").agg(F.count("*").alias("n_lines"), F.count_if(text.is_code(F.col("line"))).alias("n_code"))


@query("""SELECT source, trunc(median(n_chars))::BIGINT AS body, CASE WHEN trunc(median(n_chars)) < 1000 THEN '<1000' WHEN trunc(median(n_chars)) <= 2000 THEN '1000-2000' ELSE '>2000' END AS size FROM documents GROUP BY source""")
def length_buckets(spark, d):
    body = table(spark, d, "documents").groupBy("source").agg(F.median("n_chars").cast("bigint").alias("body"))
    return body.withColumn("size", F.when(F.col("body") < 1000, "<1000").when(F.col("body") <= 2000, "1000-2000").otherwise(">2000"))


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
ends_with(lower(regexp_extract(url, '://([^/?#]*)', 1)), '.example.com') AS covered FROM pages""")
def url_parts(spark, d):
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    return table(spark, d, "pages").select(
        "page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), host.alias("host"), F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("path"),
        keys.covers(F.replace(host, F.lit("."), F.lit("/")), F.lit("example/com")).alias("covered"),
    )


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS pos FROM documents),
p AS (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM w),
v AS (SELECT *, b >= 50 AND b + length(word) <= 250 AS seen FROM p)
SELECT doc_id, count(*) AS n_words, min(b)::BIGINT AS begins, max(b + length(word))::BIGINT AS ends FROM v WHERE seen GROUP BY doc_id""")
def visible_run(spark, d):
    """Whole words within characters 50 to 250 of a text: along a line the visible words are one run."""
    words = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = words.withColumn("b", F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0))).withColumn("e", F.col("b") + F.length("word"))
    return placed.filter("b >= 50 and e <= 250").groupBy("doc_id").agg(F.count("*").alias("n_words"), F.min("b").cast("bigint").alias("begins"), F.max("e").cast("bigint").alias("ends"))


# Windows and folds


@query("""SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM role AS breaks FROM conversations""")
def paragraph_breaks(spark, d):
    earlier = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", (~earlier.eqNullSafe(F.col("role"))).alias("breaks"))


@query("""WITH l AS (SELECT doc_id, n_chars, CASE WHEN n_chars <= 1024 THEN [0] ELSE list_append(range(0, n_chars - 1024, 960), n_chars - 1024) END AS starts FROM documents)
SELECT doc_id, len(starts) AS n_tiles, list_max(starts)::BIGINT AS last_start FROM l""")
def tile_windows(spark, d):
    starts = table(spark, d, "documents").select("doc_id", arrays.tile_starts(F.col("n_chars"), 1024, 64).alias("starts"))
    return starts.select("doc_id", F.size("starts").cast("bigint").alias("n_tiles"), F.array_max("starts").alias("last_start"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM orders)
WHERE best IS NULL OR o_totalprice > best""")
def best_so_far(spark, d):
    best = F.max("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1))
    return table(spark, d, "orders").withColumn("best", best).filter("best is null or o_totalprice > best").select("o_custkey", "o_orderkey", "o_totalprice")


_DAYS = "WITH days AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 6) AS v FROM events GROUP BY ALL)"


def days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(r6(F.avg("value")).alias("v"))


@query(_DAYS + " SELECT event_type, day, round(avg(v) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM days")
def moving_average(spark, d):
    near = Window.partitionBy("event_type").orderBy("day").rowsBetween(-2, 2)
    return days(spark, d).select("event_type", "day", r6(F.avg("v").over(near)).alias("smooth"))


@query("SELECT event_id // 50 AS window, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1")
def tumbling_log_means(spark, d):
    return table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 50).alias("window")).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean_value"))


@query(_DAYS + """, l AS (SELECT event_type, list(v ORDER BY day) AS vs FROM days GROUP BY 1)
SELECT event_type, round(list_reduce(list_transform(vs, lambda v: struct_pack(n := 1.0::DOUBLE, x := v)), lambda s, v: struct_pack(n := s.n + 1,
  x := least(0.99, (2 + s.n) / (11 + s.n)) * s.x + (1 - least(0.99, (2 + s.n) / (11 + s.n))) * v.x)).x, 6) AS ema FROM l""")
def ema_scan(spark, d):
    """The days of one event type are a short, bounded series."""
    series = days(spark, d).groupBy("event_type").agg(F.sort_array(F.collect_list(F.struct("day", "v"))).alias("s"))
    return series.select("event_type", r6(arrays.warm_average(F.col("s.v"), 0.99)).alias("ema"))


@query()
def reading_order(spark, d):
    """Boxes of an order's line items: rows by vertical centre, each left to right. Tested against a plain fold."""
    box = F.struct(((F.col("l_quantity") * 2 + 5) / 2).alias("centre"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("y0"), (F.col("l_quantity") + 5).alias("y1"), F.col("l_extendedprice").alias("x0"))
    boxes = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(box)).alias("boxes"))
    rows = boxes.select("l_orderkey", arrays.reading_order(F.col("boxes")).alias("rows"))
    read = F.transform("rows", lambda r: F.array_join(F.transform(F.array_sort(F.transform(r, lambda b: F.struct(b["x0"], b["part"], b["line"]))), lambda b: b["part"].cast("string")), " "))
    return rows.select("l_orderkey", F.size("rows").cast("bigint").alias("n_rows"), F.array_join(read, "\n").alias("reading"))


@query()
def greedy_wrap(spark, d):
    """Lines of at most 40 characters that the words of a text fill; all its words."""
    words = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    return table(spark, d, "documents").select("doc_id", arrays.wrapped_lines(words, 40).alias("n_lines"))


# Arrays


@query("""WITH f AS (SELECT label, arg_min(embedding, vec_id) AS base FROM embeddings GROUP BY 1),
m AS (SELECT vec_id, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (embedding[i]::DOUBLE - base[i]::DOUBLE) * (embedding[i]::DOUBLE - base[i]::DOUBLE))) / len(embedding) AS e FROM embeddings JOIN f USING (label))
SELECT vec_id, round(CASE WHEN e <= 0 THEN 100.0 ELSE least(100.0, 10 * log10(1.0 / e)) END, 6) AS psnr FROM m""")
def vector_psnr(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    base = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("base"))
    return rows.join(base, "label").select("vec_id", r6(arrays.psnr(arrays.mse(F.col("embedding"), F.col("base")), 1.0)).alias("psnr"))


@query("""WITH f AS (SELECT label, arg_min(embedding, vec_id) AS base FROM embeddings GROUP BY 1),
p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS y, unnest(base)::DOUBLE AS x FROM embeddings JOIN f USING (label)),
c AS (SELECT vec_id, CASE WHEN var_pop(x) <= 1e-6 THEN 1.0 ELSE covar_pop(y, x) / var_pop(x) END AS slope, avg(y) AS my, avg(x) AS mx FROM p GROUP BY 1)
SELECT vec_id, round(slope, 5) AS slope, round(my - slope * mx, 5) AS intercept FROM c""")
def colour_fit_residual(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("y"))
    base = rows.groupBy("label").agg(F.min_by("y", "vec_id").alias("x"))
    long = rows.join(base, "label").select("vec_id", F.explode(F.arrays_zip("y", "x")).alias("p")).select("vec_id", "p.y", "p.x")
    slope = F.when(F.var_pop("x") <= 1e-6, 1.0).otherwise(F.covar_pop("y", "x") / F.var_pop("x"))
    fit = long.groupBy("vec_id").agg(slope.alias("slope"), F.avg("y").alias("my"), F.avg("x").alias("mx"))
    return fit.select("vec_id", F.round("slope", 5).alias("slope"), F.round(F.col("my") - F.col("slope") * F.col("mx"), 5).alias("intercept"))


@query("""WITH m AS (SELECT median(l_extendedprice) AS mid FROM lineitem), s AS (SELECT mid, median(abs(l_extendedprice - mid)) AS mad FROM lineitem, m GROUP BY mid)
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem, s WHERE l_extendedprice > mid + 1.2 * (1.4826 * mad + 1e-6) ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100""")
def robust_peaks(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return summaries.outliers(rows, "l_extendedprice", 1.2).orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(100)


# Jobs


def queue(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns as jobs: each needs the one before; even turns of even conversations are done, every seventh failed."""
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn").withColumn("attempt", F.lit(1))
    edges = rows.filter("turn > 0").select("id", (F.col("id") - 1).alias("needs"))
    state = F.when((F.col("turn") % 2 == 0) & (F.col("conv_id") % 2 == 0), "done").when(F.col("id") % 7 == 0, "failed")
    status = rows.select("id", state.alias("status"), F.when(F.col("id") % 14 == 0, 1).otherwise(0).alias("at_attempt")).filter("status is not null")
    return rows, edges, status


_QUEUE = """WITH j AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn FROM conversations), st AS (SELECT id, CASE WHEN turn % 2 = 0 AND conv_id % 2 = 0 THEN 'done' WHEN id % 7 = 0 THEN 'failed' END AS status, CASE WHEN id % 14 = 0 THEN 1 ELSE 0 END AS at_attempt FROM j),
e AS (SELECT id, count(*) AS n_waiting FROM j WHERE turn > 0 AND id - 1 NOT IN (SELECT id FROM st WHERE status = 'done') GROUP BY id),
s AS (SELECT id, CASE WHEN status = 'done' THEN 'done' WHEN status = 'failed' AND at_attempt = 1 THEN 'failed' WHEN n_waiting > 0 THEN 'waiting' ELSE 'runnable' END AS state, coalesce(n_waiting, 0) AS n_waiting FROM j JOIN st USING (id) LEFT JOIN e USING (id))
"""


@query(_QUEUE + "SELECT id, state, n_waiting FROM s")
def queue_listing(spark, d):
    return jobs.job_states(*queue(spark, d))


@query(_QUEUE + "SELECT id FROM s WHERE state = 'runnable' ORDER BY id LIMIT 1")
def job_select(spark, d):
    return jobs.job_states(*queue(spark, d)).filter("state = 'runnable'").orderBy("id").limit(1).select("id")


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'balance is negative' END, CASE WHEN c_nationkey NOT BETWEEN 0 AND 19 THEN 'unknown nation' END,
  CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'segment not allowed' END, CASE WHEN NOT starts_with(c_name, 'Customer') THEN 'name is not an id' END], lambda x: x IS NOT NULL), '; ') AS problems FROM customer""")
def spec_violations(spark, d):
    bad = jobs.violations([
        ("balance is negative", F.col("c_acctbal") < 0), ("unknown nation", ~F.col("c_nationkey").between(0, 19)),
        ("segment not allowed", ~F.col("c_mktsegment").isin("BUILDING", "MACHINERY")), ("name is not an id", ~F.col("c_name").startswith("Customer")),
    ])
    return table(spark, d, "customer").select("c_custkey", F.array_join(bad, "; ").alias("problems"))


@query("""WITH m AS (SELECT p_type, p_brand, avg(p_retailprice) AS v FROM part GROUP BY ALL), b AS (SELECT p_type, min(p_brand) AS base FROM part WHERE p_type LIKE 'S%' OR p_type LIKE 'E%' GROUP BY 1)
SELECT m.p_type, m.p_brand, round(m.v - bm.v, 6) AS gain FROM m LEFT JOIN b USING (p_type) LEFT JOIN m bm ON bm.p_type = m.p_type AND bm.p_brand = b.base""")
def prefix_baseline(spark, d):
    """Types whose name begins with S or E have a baseline: their first brand."""
    means = table(spark, d, "part").groupBy("p_type", "p_brand").agg(F.avg("p_retailprice").alias("v"))
    kind = summaries.prefix_baselines(means, "p_type", [("S", "first"), ("E", "first")])
    first = F.min("p_brand").over(Window.partitionBy("p_type"))
    marked = means.withColumn("base", F.when(kind == "first", first))
    base = marked.filter("p_brand = base").select(F.col("p_type").alias("_t"), F.col("v").alias("_v"))
    return marked.join(base, F.col("p_type") == F.col("_t"), "left").select("p_type", "p_brand", r6(F.col("v") - F.col("_v")).alias("gain"))


@query("""WITH f AS (SELECT * FROM part WHERE p_retailprice <= 0.75 * (SELECT max(p_retailprice) FROM part)), s AS (SELECT max(p_size) AS size FROM f)
SELECT p_type, max(p_retailprice) AS price, arg_max(p_partkey, (p_retailprice, p_partkey)) AS p_partkey FROM f, s WHERE p_size = size GROUP BY p_type""")
def recommend(spark, d):
    part = table(spark, d, "part")
    most = part.agg(F.max("p_retailprice")).first()[0]
    fits = part.filter(F.col("p_retailprice") <= 0.75 * F.lit(most))
    largest = fits.agg(F.max("p_size")).first()[0]
    best = F.max(F.struct("p_retailprice", "p_partkey")).alias("best")
    return fits.filter(F.col("p_size") == largest).groupBy("p_type").agg(best).select("p_type", F.col("best.p_retailprice").alias("price"), "best.p_partkey")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_exactly_once(spark, d):
    """The events as a stream, sent twice: the second run over the same files finds every key recorded."""
    folder = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    for i in range(2):
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
        append_once(stream, f"{folder}/events", ["event_id"], f"{folder}/checkpoint-{i}")
    return spark.read.schema(schema).parquet(f"{folder}/events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def work_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for what all executors share; in local mode, if unset, the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(shared or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/pagemill"
