"""Names that a text says are gone: words bound by "no", "without", "removed" and their like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomery.plans.registry import query
from loomery.sources.tables import table

# What binds the words behind it, what binds those before it, a word that joins the first kind, and both kinds inside a run of Chinese.
BEFORE, AFTER, MORE = ("no", "without"), ("free", "removed"), "more"
WIDE_BEFORE, WIDE_AFTER = "无", "已移除"
#: Words of a name at most.
LONGEST = 3
#: Sentences end here; brackets begin and end parts.
ENDS, TOKEN, OPEN, CLOSE = r"[.!?;。！？；\n]+", r"[\p{L}\p{N}]+|[()\[\]{}（）]", r"[(\[{（]", r"[)\]}）]"

_B, _A = (", ".join(f"'{w}'" for w in kind) for kind in (BEFORE, AFTER))
PARTS = rf"""sentence AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS sentence FROM (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '{ENDS}') AS p FROM documents)),
token AS (SELECT doc_id, sentence, unnest(t) AS t, generate_subscripts(t, 1) AS k FROM (SELECT doc_id, sentence, regexp_extract_all(s, '{TOKEN}') AS t FROM sentence)),
bracket AS (SELECT *, regexp_matches(t, '^{OPEN}$') AS opens, regexp_matches(t, '^{CLOSE}$') AS closes FROM token),
part AS (SELECT *, sum(opens::INT + closes::INT) OVER w AS part, sum(opens::INT - closes::INT) OVER w > 0 AS inside FROM bracket WINDOW w AS (PARTITION BY doc_id, sentence ORDER BY k)),
words AS (SELECT doc_id, sentence, part, any_value(inside) AS inside, list(t ORDER BY k) AS w FROM part WHERE NOT opens AND NOT closes GROUP BY ALL),
at_ AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM words),
slot AS (SELECT *, w[i] AS frame, 'before' AS kind, CASE WHEN w[i] = '{BEFORE[0]}' AND i < len(w) AND w[i + 1] = '{MORE}' THEN i + 2 ELSE i + 1 END AS a FROM at_ WHERE w[i] IN ({_B})
         UNION ALL SELECT *, w[i], 'after', i - 1 FROM at_ WHERE w[i] IN ({_A})),
span AS (SELECT *, unnest(range(1, {LONGEST + 1})) AS size FROM slot),
name AS (SELECT doc_id, sentence, part, inside, i, frame, CASE WHEN kind = 'before' THEN w[a:a + size - 1] ELSE w[a - size + 1:a] END AS name, size FROM span
         WHERE CASE WHEN kind = 'before' THEN a + size - 1 <= len(w) ELSE a - size + 1 >= 1 END),
wide AS (SELECT doc_id, sentence, part, inside, i, '{WIDE_BEFORE}' AS frame, substr(w[i], 2) AS name FROM at_ WHERE w[i] LIKE '{WIDE_BEFORE}_%'
         UNION ALL SELECT doc_id, sentence, part, inside, i, '{WIDE_AFTER}', left(w[i], length(w[i]) - {len(WIDE_AFTER)}) FROM at_ WHERE w[i] LIKE '_%{WIDE_AFTER}'),
bound AS (SELECT doc_id, sentence, part, i, frame, array_to_string(name, '_') AS name, inside FROM name WHERE NOT list_has_any(name, [{_B}, {_A}]) UNION ALL SELECT doc_id, sentence, part, i, frame, name, inside FROM wide)"""


def bound_names(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, sentence, part, pos, frame, name, in_brackets: runs of one to three words that a frame binds.

    A frame is a whole word, and binds words of its own part only: brackets and the ends of
    sentences end it. A name holds no frame word; a frame with nothing beside it binds nothing. Null
    and empty texts have none. Joints such as ``_`` part words.
    """
    lines = texts.select(key, F.posexplode(F.split(F.lower(F.coalesce("text", F.lit(""))), ENDS)).alias("sentence", "s"))
    # Most sentences have no frame word; the test keeps all that may have one.
    lines = lines.where(F.col("s").rlike("|".join([*BEFORE, *AFTER, WIDE_BEFORE, WIDE_AFTER])))
    token = lines.select(key, (F.col("sentence") + 1).alias("sentence"), F.posexplode(F.regexp_extract_all("s", F.lit(TOKEN), 0)).alias("k", "t"))
    token = token.withColumn("opens", F.col("t").rlike(f"^{OPEN}$").cast("int")).withColumn("closes", F.col("t").rlike(f"^{CLOSE}$").cast("int"))
    own = Window.partitionBy(key, "sentence").orderBy("k")
    token = token.withColumn("part", F.sum(F.col("opens") + F.col("closes")).over(own)).withColumn("inside", F.sum(F.col("opens") - F.col("closes")).over(own) > 0)
    g = token.where("opens + closes = 0").groupBy(key, "sentence", "part", "inside")
    g = g.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]).alias("w"))
    at = g.select("*", F.posexplode("w").alias("i", "frame")).withColumn("i", F.col("i") + 1)
    found = at.select(key, "sentence", "part", F.col("i").alias("pos"), F.col("inside").alias("in_brackets"), F.inline(_names()))
    return found.select(key, "sentence", "part", "pos", "frame", "name", "in_brackets")


def _names() -> Column:
    """The names that the word at ``i`` binds, as (frame, name)."""
    w, i, word = F.col("w"), F.col("i"), F.col("frame")
    none = F.array().cast("array<struct<frame:string,name:string>>")
    first = F.when((word == BEFORE[0]) & (F.get(w, i) == MORE), i + 2).otherwise(i + 1)
    sizes = F.array(*map(F.lit, range(1, LONGEST + 1)))
    clean = lambda x: ~F.exists(x, lambda y: y.isin(*BEFORE, *AFTER))
    spell = lambda run: F.transform(F.filter(run, clean), lambda x: F.struct(word.alias("frame"), F.array_join(x, "_").alias("name")))
    behind = F.transform(F.filter(sizes, lambda n: first + n - 1 <= F.size(w)), lambda n: F.slice(w, first, n))
    ahead = F.transform(F.filter(sizes, lambda n: i - n >= 1), lambda n: F.slice(w, i - n, n))
    one = lambda frame, name: F.array(F.struct(F.lit(frame).alias("frame"), name.alias("name")))
    words = F.when(word.isin(*BEFORE), spell(behind)).when(word.isin(*AFTER), spell(ahead)).otherwise(none)
    longer = lambda n: F.length(word) > n
    lead = F.when(word.startswith(WIDE_BEFORE) & longer(len(WIDE_BEFORE)), one(WIDE_BEFORE, F.substring(word, len(WIDE_BEFORE) + 1, 1 << 30))).otherwise(none)
    tail = F.when(word.endswith(WIDE_AFTER) & longer(len(WIDE_AFTER)), one(WIDE_AFTER, F.substring(word, F.lit(1), F.length(word) - len(WIDE_AFTER)))).otherwise(none)
    return F.concat(words, lead, tail)


@query(f"WITH {PARTS} SELECT doc_id, sentence::INTEGER AS sentence, part::BIGINT AS part, i::INTEGER AS pos, frame, name, inside AS in_brackets FROM bound")
def gone_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that documents say are gone, sentence by sentence."""
    return bound_names(table(spark, sf_dir, "documents"))


from loomery.plans import registry as registry  # All queries are registered, in one order, whichever module is asked for first.
