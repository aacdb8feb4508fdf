"""BM25 over part names, in integers, and words that occur together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.plans.registry import query
from loomery.session import settled
from loomery.sources.tables import table

# Channels of a unit's evidence with their weight in a query; 256, 22, 10, 3, 9 and 65536 below scale and weigh.
CHANNELS = {"name": 3, "callee": 2, "shape": 1}
TOP = 5

BAG = """bag AS (
    SELECT id, term, count(*) AS tf FROM (
        SELECT p_partkey AS id, 'name:' || unnest(string_split(lower(p_name), ' ')) AS term FROM part
        UNION ALL SELECT p_partkey, 'shape:' || unnest(string_split(lower(p_type), ' ')) FROM part
        UNION ALL SELECT p_partkey, 'callee:' || replace(lower(p_brand), '#', '') FROM part) GROUP BY id, term),
size AS (SELECT id, sum(tf)::BIGINT AS len FROM bag GROUP BY id),
n AS (SELECT count(*) AS n, greatest(1, sum(len)::BIGINT // count(*)) AS avg FROM size),
df AS (SELECT term, count(*) AS df FROM bag GROUP BY term),
idf AS (SELECT term, df, CASE WHEN 2 * n + 1 - 2 * df <= 2 * df + 1 THEN 0 ELSE floor(256 * log2((2 * n + 1 - 2 * df)::DOUBLE / (2 * df + 1)))::BIGINT END AS idf FROM df, n)"""


def bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, term, tf: the words of each part in their channels; one word in two channels is two terms."""
    p = table(spark, sf_dir, "part")
    of = lambda label, words: F.transform(words, lambda w: F.concat(F.lit(label + ":"), w))
    words = F.concat(
        of("name", F.split(F.lower("p_name"), " ")), of("shape", F.split(F.lower("p_type"), " ")), of("callee", F.array(F.regexp_replace(F.lower("p_brand"), "#", "")))
    )
    return p.select(F.col("p_partkey").alias("id"), F.explode(words).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def statistics(bag: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, len), one row with n and avg, (term, df, idf): idf in 1/256, 0 for terms of half the units."""
    size = bag.groupBy("id").agg(F.sum("tf").alias("len"))
    n = size.agg(F.count("*").alias("n"), F.greatest(F.lit(1), F.expr("sum(len) div count(*)")).alias("avg"))
    df = bag.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n))
    ratio = (2 * F.col("n") + 1 - 2 * F.col("df")).cast("double") / (2 * F.col("df") + 1)
    common = 2 * F.col("n") + 1 - 2 * F.col("df") <= 2 * F.col("df") + 1
    return size, n, df.select("term", "df", F.when(common, 0).otherwise(F.floor(256 * F.log2(ratio))).cast("long").alias("idf"))


@query(f"WITH {BAG} SELECT term, df, idf FROM idf")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics(bags(spark, sf_dir))[2]


SCORED = """ask AS (SELECT id AS q, term, CASE WHEN term LIKE 'name:%' THEN 3 WHEN term LIKE 'callee:%' THEN 2 ELSE 1 END * tf * 256 AS w FROM bag WHERE id % 20 = 0),
score AS (SELECT q, bag.id, sum(((w * idf * 22 * tf * avg)::HUGEINT * 65536 // (10 * tf * avg + 3 * avg + 9 * len))) AS score,
                 count(*) FILTER (WHERE term LIKE 'name:%') AS n_name, count(*) FILTER (WHERE term LIKE 'callee:%') AS n_callee, count(*) FILTER (WHERE term LIKE 'shape:%') AS n_shape
          FROM ask JOIN idf USING (term) JOIN bag USING (term) JOIN size USING (id), n WHERE idf > 0 AND bag.id <> q GROUP BY q, bag.id),
top AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM score),
shape AS (SELECT id, string_agg(term, ' ' ORDER BY term) AS shape FROM bag WHERE term LIKE 'shape:%' GROUP BY id)"""


@query(
    f"""WITH {BAG}, {SCORED} SELECT q, rank, top.id, score::BIGINT AS score, n_name, n_callee, n_shape,
       (n_name >= 1 AND n_callee >= 1) OR (n_name >= 2 AND a.shape IS NOT DISTINCT FROM b.shape) AS same_role
       FROM top LEFT JOIN shape a ON a.id = q LEFT JOIN shape b ON b.id = top.id WHERE rank <= 5"""
)
def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every twentieth part, the five parts that say most in the same words.

    Contributions are whole numbers, divided term by term before they are summed, so the order of
    the sum cannot matter. Terms that half the parts have score nothing and are left out before the join.
    """
    return best_matches(bags(spark, sf_dir), F.col("id") % 20 == 0)


def kinds_of_bags(bag: DataFrame) -> DataFrame:
    """id, kind: units of equal bags are of one kind, named by the smallest id."""
    g = bag.groupBy("id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("term", "tf")))).alias("form"))
    g = settled(g, "bags")
    return settled(g.join(g.groupBy("form").agg(F.min("id").alias("kind")), "form").select("id", "kind"), "kinds")


def best_matches(bag: DataFrame, asks: Column, top: int = TOP) -> DataFrame:
    """q, rank, id and scores: for every unit that ``asks`` holds for, the ``top`` units that say most in the same words.

    A score depends on the two bags alone, so bags are scored, not units: the work grows with the
    number of different bags. Each of the best ``top + 1`` bags (by score, then smallest id) has at
    least one unit, so no unit of another bag can be among the best ``top``, the asker left out.
    """
    bag = settled(bag, "bags")
    size, n, idf = statistics(bag)
    of_unit = kinds_of_bags(bag)
    own = bag.join(of_unit.where("id = kind").select("id"), "id", "left_semi")
    asked = settled(of_unit.where(asks).select(F.col("id").alias("q"), F.col("kind").alias("q_kind")), "asked")
    weight = F.coalesce(*[F.when(F.col("term").startswith(c + ":"), w) for c, w in CHANNELS.items()]) * F.col("tf") * 256
    ask = own.join(asked.select(F.col("q_kind").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("q_kind"), "term", weight.alias("w"))
    ask = settled(ask.join(idf.where("idf > 0"), "term").join(F.broadcast(n)).select("q_kind", "term", F.expr("cast(w as bigint) * idf * 22 * avg * 65536").alias("w")), "asked")
    # Of a posting, what is the same for every question: its tf, and the divisor.
    posts = settled(own.join(size, "id").join(F.broadcast(n)).select("id", "term", "tf", F.expr("10 * tf * avg + 3 * avg + 9 * len").alias("over")), "postings")
    # 64 bits; what passes them is an error and no wrong score.
    part = F.expr("(w * tf) div over")
    of = lambda c: F.count_if(F.col("term").startswith(c + ":")).alias(f"n_{c}")
    score = ask.join(posts, "term").groupBy("q_kind", "id").agg(F.sum(part).alias("score"), *map(of, CHANNELS))
    by_score = Window.partitionBy("q_kind").orderBy(F.desc("score"), "id")
    best = settled(score.withColumn("at", F.row_number().over(by_score)).where(F.col("at") <= top + 1).drop("at").withColumnRenamed("id", "kind"), "best")
    few = of_unit.withColumn("at", F.row_number().over(Window.partitionBy("kind").orderBy("id"))).where(F.col("at") <= top + 1).drop("at")
    hit = asked.join(best, "q_kind").join(few, "kind").where("id <> q")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    hit = hit.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    shape = shapes(own).withColumnRenamed("id", "kind")
    hit = hit.join(shape, "kind", "left").join(shape.select(F.col("kind").alias("q_kind"), F.col("shape").alias("asked")), "q_kind", "left")
    role = ((F.col("n_name") >= 1) & (F.col("n_callee") >= 1)) | ((F.col("n_name") >= 2) & F.col("shape").eqNullSafe(F.col("asked")))
    return hit.select("q", "rank", "id", "score", "n_name", "n_callee", "n_shape", role.alias("same_role"))


def shapes(bag: DataFrame) -> DataFrame:
    """id, shape: the sorted shape terms of each unit as one string; two units have one shape if these are equal."""
    g = bag.where(F.col("term").startswith("shape:")).groupBy("id")
    return g.agg(F.array_join(F.sort_array(F.collect_set("term")), " ").alias("shape"))


PAIRS = """pair AS (SELECT a.term AS a, b.term AS b, count(*) AS n_ab FROM bag a JOIN bag b ON a.id = b.id AND a.term < b.term GROUP BY ALL),
known AS (SELECT a, b, n_ab, x.df AS n_a, y.df AS n_b, n FROM pair JOIN df x ON x.term = a JOIN df y ON y.term = b, n WHERE n_ab >= 2)"""


def cooccurrence(bag: DataFrame) -> DataFrame:
    """a, b, n_ab of terms that at least two units hold both, a < b. A unit's bag is short."""
    x, y = bag.select("id", F.col("term").alias("a")), bag.select("id", F.col("term").alias("b"))
    return x.join(y, "id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_ab")).where("n_ab >= 2")


@query(f"WITH {BAG}, {PAIRS} SELECT a, b, n_ab, n_a, n_b FROM known")
def cooccurring_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    bag = bags(spark, sf_dir)
    df = bag.groupBy("term").agg(F.count("*").alias("df"))
    pair = cooccurrence(bag).join(df.select(F.col("term").alias("a"), F.col("df").alias("n_a")), "a")
    return pair.join(df.select(F.col("term").alias("b"), F.col("df").alias("n_b")), "b").select("a", "b", "n_ab", "n_a", "n_b")


NEAR = """e AS (SELECT a AS term, b AS near, n_ab, n_a, n_b, n FROM known UNION ALL SELECT b, a, n_ab, n_b, n_a, n FROM known)"""


def neighbours(bag: DataFrame, where: str) -> DataFrame:
    """term, rank, near, n_ab: for each term the three most tied to it by pointwise mutual information, of pairs ``where`` holds for.

    Neighbours that more than a quarter of the units hold say nothing and are left out.
    """
    df, n = bag.groupBy("term").agg(F.count("*").alias("df")), statistics(bag)[1]
    pair = cooccurrence(bag)
    both = pair.select(F.col("a").alias("term"), F.col("b").alias("near"), "n_ab").unionAll(pair.select("b", "a", "n_ab"))
    both = both.join(df.select("term", F.col("df").alias("n_a")), "term").join(df.select(F.col("term").alias("near"), F.col("df").alias("n_b")), "near")
    both = both.join(F.broadcast(n)).where("4 * n_b <= n").where(where)
    lift = (F.col("n_ab") * F.col("n")).cast("double") / (F.col("n_a") * F.col("n_b"))
    rank = F.row_number().over(Window.partitionBy("term").orderBy(lift.desc(), "near"))
    return both.withColumn("rank", rank.cast("long")).where("rank <= 3").select("term", "rank", "near", "n_ab")


@query(
    f"""WITH {BAG}, {PAIRS}, {NEAR}, r AS (SELECT term, near, n_ab, row_number() OVER (PARTITION BY term ORDER BY (n_ab * n)::DOUBLE / (n_a * n_b) DESC, near) AS rank
             FROM e WHERE 4 * n_b <= n AND n_ab * n >= 4 * n_a * n_b)
       SELECT term, rank, near, n_ab FROM r WHERE rank <= 3"""
)
def ppmi_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of two bits or more."""
    return neighbours(bags(spark, sf_dir), "n_ab * n >= 4 * n_a * n_b")


@query(
    f"""WITH {BAG}, {PAIRS}, {NEAR}, r AS (SELECT term, near, n_ab, row_number() OVER (PARTITION BY term ORDER BY (n_ab * n)::DOUBLE / (n_a * n_b) DESC, near) AS rank
             FROM e WHERE 4 * n_b <= n AND n_ab * n > n_a * n_b)
       SELECT term, rank, near, n_ab FROM r WHERE rank <= 3"""
)
def tied_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of more than no bits."""
    return neighbours(bags(spark, sf_dir), "n_ab * n > n_a * n_b")


@query(
    """WITH now AS (SELECT p_partkey AS id, CASE WHEN p_size = 2 THEN lower(p_type) ELSE lower(p_name) END AS text FROM part WHERE p_size <> 1)
       SELECT term, count(DISTINCT id) AS df FROM (SELECT id, unnest(string_split(text, ' ')) AS term FROM now) GROUP BY term"""
)
def maintained_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies kept by signed changes; the SQL counts the new state anew.

    Stored are those of all parts below size 40. Then those of size 1 go, those of size 2 are
    rewritten, and those of 40 and more come.
    """
    p = table(spark, sf_dir, "part")
    of = lambda d, text: d.select(F.explode(F.array_distinct(F.split(F.lower(text), " "))).alias("term"))
    stored = of(p.where("p_size < 40"), "p_name").groupBy("term").agg(F.count("*").alias("df"))
    gone = of(p.where("p_size in (1, 2)"), "p_name").withColumn("df", F.lit(-1).cast("long"))
    new = of(p.where("p_size = 2"), "p_type").unionAll(of(p.where("p_size >= 40"), "p_name")).withColumn("df", F.lit(1).cast("long"))
    return upkeep(stored, gone.unionAll(new))


def upkeep(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """term, df after signed changes; a term that nothing holds any more is dropped."""
    delta = changes.groupBy("term").agg(F.sum("df").alias("df"))
    return stored.unionByName(delta).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
