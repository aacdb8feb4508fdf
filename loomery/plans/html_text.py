"""Text of pages by block elements: what each says itself, over which rows, and what is exempt from judging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomery.functions import words
from loomery.plans.registry import query
from loomery.session import settled
from loomery.sources.tables import table

#: Elements that hold blocks, and the one that ends where any block begins or ends.
HOLDERS = (
    "html head body title main nav article aside section header footer address blockquote div form fieldset figure figcaption "
    "h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th"
).split()
PARAGRAPH = "p"
#: Comments, scripts, styles and code are one token each; the rest are tags and what is between them. A lone < is text.
TOKEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<pre\b.*?</pre>|<code\b.*?</code>|<[/!?a-zA-Z][^>]*>|[^<]+|<"
SCRIPT, CODE = r"(?is)^<(script|style)\b.*</(script|style)>", r"(?is)^<(pre|code)\b.*</(pre|code)>"
NAME = "^</?([a-zA-Z][a-zA-Z0-9]*)"
ENTITY = "&#?[a-zA-Z0-9]+;"
#: A comment that exempts the element it stands in; it must say why.
ALLOW, WHY = r"allow\(duplicate\)", r"allow\(duplicate\)[ \t]*--[ \t]*[^ \t\r\n>-]"
#: Words that a segment needs to be judged, and the most that one may have; longer ones are counted, and only they go unjudged.
FLOOR, SEQUENCE = 50, 4096

_HOLD = ", ".join(f"'{t}'" for t in HOLDERS)
SEGMENTS = rf"""tok AS (SELECT page_id, unnest(t) AS t, generate_subscripts(t, 1) AS k FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '{TOKEN}') AS t FROM pages)),
kinds AS (SELECT page_id, t, k, CASE WHEN t LIKE '<!--%' THEN 'comment' WHEN regexp_matches(t, '{SCRIPT}') THEN 'script' WHEN regexp_matches(t, '{CODE}') THEN 'code'
                 WHEN t LIKE '</%' THEN 'close' WHEN t LIKE '<_%' THEN 'open' ELSE 'text' END AS kind, lower(regexp_extract(t, '{NAME}', 1)) AS tag,
                 length(t) - length(replace(t, chr(10), '')) AS ends, length(regexp_replace(t, '[ \t\n\f\r]+$', '')) - length(replace(regexp_replace(t, '[ \t\n\f\r]+$', ''), chr(10), '')) AS inner_ends FROM tok),
edges AS (SELECT *, kind IN ('open', 'close') AND tag IN ({_HOLD}) AS holds, kind IN ('open', 'close') AND tag = '{PARAGRAPH}' AS para FROM kinds),
deep AS (SELECT *, sum(CASE WHEN NOT holds THEN 0 WHEN kind = 'open' THEN 1 ELSE -1 END) OVER w AS depth,
                1 + sum(ends) OVER w - ends AS row, last_value(CASE WHEN holds OR para THEN CASE WHEN para AND kind = 'open' THEN k ELSE 0 END END IGNORE NULLS) OVER w AS in_para
         FROM edges WINDOW w AS (PARTITION BY page_id ORDER BY k)),
owned AS (SELECT *, CASE WHEN in_para > 0 THEN in_para ELSE coalesce(last_value(CASE WHEN holds AND kind = 'open' THEN k END IGNORE NULLS) OVER (PARTITION BY page_id, depth ORDER BY k), 0) END AS seg FROM deep),
said AS (SELECT page_id, seg, k, row + inner_ends AS last, regexp_extract_all(lower(regexp_replace(t, '{ENTITY}', ' ', 'g')), '[\p{{L}}\p{{N}}]+') AS w FROM owned WHERE kind = 'text'),
text AS (SELECT page_id, seg, max(last) FILTER (WHERE len(w) > 0) AS last, sum(len(w)) AS n_words, string_agg(array_to_string(w, ' '), ' ' ORDER BY k) FILTER (WHERE len(w) > 0) AS words FROM said GROUP BY ALL HAVING sum(len(w)) > 0),
claim AS (SELECT page_id, seg, bool_or(regexp_matches(t, '{WHY}')) AS allowed, count(*) FILTER (WHERE NOT regexp_matches(t, '{WHY}')) AS without_why FROM owned WHERE kind = 'comment' AND regexp_matches(t, '{ALLOW}') GROUP BY ALL),
seg AS (SELECT x.page_id, x.seg::INTEGER AS seg, coalesce(o.tag, '') AS tag, coalesce(o.row, 1)::BIGINT AS first, x.last::BIGINT AS last, n_words::BIGINT AS n_words, words,
               coalesce(allowed, false) AS allowed, coalesce(without_why, 0) AS without_why
        FROM text x LEFT JOIN owned o ON o.page_id = x.page_id AND o.k = x.seg LEFT JOIN claim c ON c.page_id = x.page_id AND c.seg = x.seg)"""


def tokens(pages: DataFrame) -> DataFrame:
    """page_id, k (from 1), t, kind, tag, row (of its first character), last (of its last that is no space), seg.

    ``seg`` is the place of the element that a token belongs to: the innermost open block, or the
    paragraph before it that no block has ended; 0 is the page itself. A null page has none. End tags too
    many lead to the page.
    """
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(TOKEN), 0)
    t = pages.select("page_id", F.posexplode(found).alias("k", "t")).withColumn("k", F.col("k") + 1)
    s = F.col("t")
    kind = F.when(s.startswith("<!--"), "comment").when(s.rlike(SCRIPT), "script").when(s.rlike(CODE), "code")
    kind = kind.when(s.startswith("</"), "close").when(s.startswith("<") & (s != "<"), "open").otherwise("text")
    ends = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    t = t.select("page_id", "k", "t", kind.alias("kind"), F.lower(F.regexp_extract("t", NAME, 1)).alias("tag"), ends(s).alias("ends"), ends(F.regexp_replace(s, "[ \t\n\f\r]+$", "")).alias("inner"))
    edge, opens = F.col("kind").isin("open", "close"), F.col("kind") == "open"
    t = t.withColumn("holds", edge & F.col("tag").isin(*HOLDERS)).withColumn("para", edge & (F.col("tag") == PARAGRAPH))
    own = Window.partitionBy("page_id").orderBy("k")
    mark = F.when(F.col("holds") | F.col("para"), F.when(F.col("para") & opens, F.col("k")).otherwise(0))
    t = t.withColumn("depth", F.sum(F.when(~F.col("holds"), 0).when(opens, 1).otherwise(-1)).over(own))
    t = t.withColumn("row", 1 + F.sum("ends").over(own) - F.col("ends")).withColumn("in_para", F.last(mark, True).over(own))
    # Of one depth, what was opened last is what is open.
    level = F.last(F.when(F.col("holds") & opens, F.col("k")), True).over(Window.partitionBy("page_id", "depth").orderBy("k"))
    seg = F.when(F.col("in_para") > 0, F.col("in_para")).otherwise(F.coalesce(level, F.lit(0)))
    return t.select("page_id", "k", "t", "kind", "tag", "row", (F.col("row") + F.col("inner")).alias("last"), seg.alias("seg"))


def segments(token: DataFrame) -> DataFrame:
    """page_id, seg, tag, first, last (rows), n_words, words, allowed, without_why of elements with words of their own."""
    said = token.where("kind = 'text'").select("page_id", "seg", "k", "last", words(F.regexp_replace("t", ENTITY, " ")).alias("w")).where(F.size("w") > 0)
    spoken = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda x: x["w"])), " ")
    text = said.groupBy("page_id", "seg").agg(F.max("last").cast("long").alias("last"), F.sum(F.size("w")).cast("long").alias("n_words"), spoken.alias("words"))
    why = F.col("t").rlike(WHY)
    claim = token.where((F.col("kind") == "comment") & F.col("t").rlike(ALLOW)).groupBy("page_id", "seg").agg(F.max(why).alias("allowed"), F.count_if(~why).alias("without_why"))
    head = token.where("kind = 'open'").select("page_id", F.col("k").alias("seg"), "tag", F.col("row").alias("first"))
    out = text.join(head, ["page_id", "seg"], "left").join(claim, ["page_id", "seg"], "left")
    return out.select(
        "page_id", "seg", F.coalesce("tag", F.lit("")).alias("tag"), F.coalesce("first", F.lit(1)).cast("long").alias("first"), "last", "n_words", "words",
        F.coalesce("allowed", F.lit(False)).alias("allowed"), F.coalesce("without_why", F.lit(0)).cast("long").alias("without_why"),
    )


@query(f"WITH {SEGMENTS} SELECT page_id, seg, tag, first, last, n_words, words, allowed FROM seg")
def html_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each block element of a page says itself, without its inner blocks, entities, comments, scripts and code."""
    return segments(settled(tokens(table(spark, sf_dir, "pages")), "page-tokens")).drop("without_why")


@query(
    f"""WITH {SEGMENTS}, s AS (SELECT CASE WHEN allowed THEN 'allowed' WHEN n_words > {SEQUENCE} THEN 'over_cap' WHEN n_words < {FLOOR} THEN 'below_floor' ELSE 'judged' END AS item, page_id, n_words, without_why FROM seg),
       shed AS (SELECT kind AS item, page_id FROM kinds WHERE kind IN ('script', 'code', 'comment'))
       SELECT item, count(*) AS n, count(DISTINCT page_id) AS n_pages, sum(n_words)::BIGINT AS n_words, sum(without_why)::BIGINT AS without_why FROM s GROUP BY item
       UNION ALL SELECT item, count(*), count(DISTINCT page_id), NULL, NULL FROM shed GROUP BY item"""
)
def html_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of all pages by what becomes of them, and what was shed. A claim that says no reason exempts nothing and is counted."""
    token = settled(tokens(table(spark, sf_dir, "pages")), "page-tokens")
    n = F.col("n_words")
    item = F.when(F.col("allowed"), "allowed").when(n > SEQUENCE, "over_cap").when(n < FLOOR, "below_floor").otherwise("judged")
    s = segments(token).groupBy(item.alias("item")).agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages"), F.sum("n_words").alias("n_words"), F.sum("without_why").alias("without_why"))
    shed = token.where(F.col("kind").isin("script", "code", "comment")).groupBy(F.col("kind").alias("item")).agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages"))
    return s.unionByName(shed, allowMissingColumns=True)


@query(
    f"""WITH {SEGMENTS}, j AS (SELECT page_id, seg, words, n_words FROM seg WHERE NOT allowed AND n_words BETWEEN 8 AND {SEQUENCE}),
       c AS (SELECT words, min(page_id) AS first_page, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM j GROUP BY words HAVING count(*) > 1)
       SELECT page_id, seg, n_words, first_page, n, n_pages FROM j JOIN c USING (words)"""
)
def html_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of eight words or more that other elements say in the same words, with the first page of each class."""
    s = segments(settled(tokens(table(spark, sf_dir, "pages")), "page-tokens")).where(~F.col("allowed") & F.col("n_words").between(8, SEQUENCE))
    # 256 bits stand for the words: what is shuffled is short.
    s = settled(s.select("page_id", "seg", "n_words", F.sha2("words", 256).alias("said")), "page-segments")
    # A page is counted once before classes are: one phrase on all pages is summed where it lies.
    each = s.groupBy("said", "page_id").agg(F.count("*").alias("n"))
    c = each.groupBy("said").agg(F.min("page_id").alias("first_page"), F.sum("n").alias("n"), F.count("*").alias("n_pages")).where("n > 1")
    return s.join(c, "said").drop("said")


def block_classes(block: DataFrame) -> DataFrame:
    """said, gone, come, first_gone, first_come: blocks that some steps of a series lose and other steps gain.

    ``block`` are distinct (host, step, said). A step loses what the version before it said and it does
    not, and gains the reverse; the first and the last version of a series have no step beyond them. All
    steps that lose a block are matched with all that gain it: a class has their numbers and
    the first of either, as (host, step), and no pairs.
    """
    ends = settled(block.groupBy("host").agg(F.min("step").alias("low"), F.max("step").alias("high")), "series")
    was = block.select("host", (F.col("step") + 1).alias("step"), "said", F.lit(1).alias("was"), F.lit(0).alias("now"))
    both = block.select("host", "step", "said", F.lit(0).alias("was"), F.lit(1).alias("now")).unionByName(was)
    one = both.groupBy("host", "step", "said").agg(F.max("was").alias("was"), F.max("now").alias("now")).where("was <> now")
    one = one.join(ends, "host").where("step > low and step <= high")
    at = F.struct("host", "step")
    g = one.groupBy("said").agg(F.sum("was").cast("long").alias("gone"), F.sum("now").cast("long").alias("come"), F.min(F.when(F.col("was") == 1, at)).alias("g"), F.min(F.when(F.col("now") == 1, at)).alias("c"))
    return g.where("gone > 0 and come > 0").select("said", "gone", "come", F.col("g.host").alias("gone_host"), F.col("g.step").alias("gone_step"), F.col("c.host").alias("come_host"), F.col("c.step").alias("come_step"))


@query(
    f"""WITH {SEGMENTS}, page AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^[a-z]+://([^/?#]*)', 1) AS host FROM pages),
       ver AS (SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id) AS step FROM page),
       b AS (SELECT DISTINCT host, step, sha256(words) AS said FROM seg JOIN ver USING (page_id)),
       ends AS (SELECT host, min(step) AS low, max(step) AS high FROM b GROUP BY ALL),
       d AS (SELECT host, step, said, 1 AS was, 0 AS now FROM (SELECT host, step + 1 AS step, said FROM b EXCEPT SELECT * FROM b) UNION ALL SELECT host, step, said, 0, 1 FROM (SELECT * FROM b EXCEPT SELECT host, step + 1, said FROM b)),
       k AS (SELECT d.* FROM d JOIN ends USING (host) WHERE step > low AND step <= high)
       SELECT said, sum(was)::BIGINT AS gone, sum(now)::BIGINT AS come, (min((host, step)) FILTER (WHERE was = 1))[1] AS gone_host, (min((host, step)) FILTER (WHERE was = 1))[2]::BIGINT AS gone_step,
              (min((host, step)) FILTER (WHERE now = 1))[1] AS come_host, (min((host, step)) FILTER (WHERE now = 1))[2]::BIGINT AS come_step FROM k GROUP BY said HAVING sum(was) > 0 AND sum(now) > 0"""
)
def block_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that leave one page of a host and come with another page, of any host; the pages of a host are its versions."""
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-z]+://([^/?#]*)", 1)
    step = F.row_number().over(Window.partitionBy("host").orderBy("page_id")).cast("long")
    version = pages.select("page_id", host.alias("host")).withColumn("step", step)
    said = segments(settled(tokens(pages), "page-tokens")).select("page_id", F.sha2("words", 256).alias("said"))
    return block_classes(settled(said.join(version, "page_id").select("host", "step", "said").distinct(), "blocks"))


from loomery.plans import registry as registry  # All queries are registered, in one order, whichever module is asked for first.
