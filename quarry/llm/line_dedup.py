"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line's tokens are its distinct words (lower-cased, split at ASCII white space); two lines match where the Jaccard
similarity of their word sets is ``NUM / DEN`` (0.8) or more. A line goes if any earlier line matches it, whether that one
stays or not. Places are ordered by doc_id, then the text's hash (which only tells apart rows that share an id), then line
number. Lines without words always stay.

A token is a long: the rarity level of the word (1.5 log2 of how often its bucket of ``BUCKETS`` occurs in all texts; levels
end at 2**42 occurrences), then 57 bits of its hash, so that sorting puts rare words first and the order is the same
everywhere. Lines with the same tokens are one class, represented by its first line. Classes meet by the tokens of their
prefixes; pairs pass the length and the positional filter. A pair that also shares the token before is left to that one, so
near copies aren't repeated for every token they share. Pairs whose 128-bit parities differ in more bits than matching sets
can differ in tokens go. What passes is verified on the words themselves, read again from the documents for the classes
concerned alone.

Cases: null and empty texts have one line without words; blank lines stay; a long line is one set; rows that repeat id and
text are one row (their lines are no copies of each other), rows that share an id alone are told apart; null ids come
first; ties don't occur, as places are distinct; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, shared_dir, store, table

NUM, DEN = 4, 5
BUCKET_BITS = 18
#: Bits of a token's hash, below its level.
BITS = 57
#: Rounds in which classes meet, each by its share of the tokens, and pairs are verified, so that only that share is shuffled at once.
ROUNDS = 3
#: Bytes of a table that is broadcast, by an estimate of its rows.
BROADCAST_BYTES = 32 << 20
BLANKS = "\t\x0b\x0c\r"


def _plain(text: Column, breaks: str = BLANKS) -> Column:
    """Lower-cased, and each of ``breaks`` a space."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for c in breaks:
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def _words(plain: Column) -> Column:
    return F.array_remove(F.split(plain, " "), "")


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BUCKET_BITS).cast("int")


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, h, line, words): h tells rows apart that share an id."""
    split = F.posexplode(F.split(_plain(F.col("text")), "\n")).alias("line", "own")
    return docs.select("doc_id", text_key(F.col("text")).alias("h"), split).select("doc_id", "h", "line", _words(F.col("own")).alias("words"))


def levels(docs: DataFrame) -> Column:
    """The rarity level of each bucket as a constant array; counts are over all words of all texts."""
    words = docs.select(F.explode(F.split(_plain(F.col("text"), BLANKS + "\n"), " ")).alias("w")).where("w <> ''")
    rows = words.select(_bucket(F.xxhash64("w")).alias("b")).groupBy("b").count().toPandas()  # a row for each bucket at most
    out = [0] * (1 << BUCKET_BITS)
    for b, n in zip(rows["b"].tolist(), rows["count"].tolist(), strict=True):
        out[b] = min(63, int(1.5 * math.log2(n)))
    return F.from_json(F.lit(json.dumps(out)), "array<int>")


def tokens(words: Column, level: Column) -> Column:
    """The line's tokens, rarest first."""

    def token(h: Column) -> Column:
        rarity = F.coalesce(F.get(level, _bucket(h)), F.lit(0)).cast("long")  # never null, so tokens sort as plain numbers
        return F.shiftleft(rarity, BITS).bitwiseOR(h.bitwiseAND((1 << BITS) - 1))

    return F.sort_array(F.transform(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), token))


def parity(toks: str, half: bool) -> Column:
    """A signature: of each of 64 bits, whether an odd number of tokens falls on it; with ``half`` only of the tokens whose
    next bit is set. Together they tell 128 bits, in which sets differ at most as often as in tokens."""
    one = F.lit(1).cast("long")

    def flip(acc: Column, t: Column) -> Column:
        bit = F.shiftrightunsigned(t, 6).bitwiseAND(one) if half else one
        return acc.bitwiseXOR(F.call_function("shiftleft", bit, t.bitwiseAND(F.lit(63).cast("long")).cast("int")))

    return F.aggregate(toks, F.lit(0).cast("long"), flip)


def least_shared(n: Column) -> Column:
    """The least number of tokens that a set of n shares with any match."""
    return F.ceil(n * NUM / F.lit(float(DEN)) - 1e-9).cast("int")


def needed(a: Column, b: Column) -> Column:
    """The least overlap of sets of sizes a and b at the threshold."""
    return F.ceil((a + b) * NUM / F.lit(float(NUM + DEN)) - 1e-9).cast("int")


def classes_of(docs: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(lines, classes), both stored: (doc_id, h, line, k1, k2) of each line with words; (c, k1, k2, first, lines, n, whole, half, prefix) of each token set."""
    rows = lines_of(docs).where(F.size("words") > 0).select("doc_id", "h", "line", tokens(F.col("words"), levels(docs)).alias("toks"))
    n = F.size("toks")
    prefix = F.slice("toks", F.lit(1), n - least_shared(n) + 1)
    keyed = rows.select("doc_id", "h", "line", F.xxhash64("toks").alias("k1"), F.xxhash64(F.lit(1), "toks").alias("k2"), n.alias("n"), parity("toks", False).alias("whole"), parity("toks", True).alias("half"), prefix.alias("prefix"))
    wide = store(keyed, f"{at}/wide")
    place = F.struct("doc_id", "h", "line")
    grouped = wide.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("lines"), *[F.first(c).alias(c) for c in ("n", "whole", "half", "prefix")])
    classes = store(grouped.withColumn("c", F.monotonically_increasing_id()), f"{at}/classes", compression="zstd")
    lines = store(wide.drop("n", "whole", "half", "prefix"), f"{at}/lines", compression="zstd")
    drop(docs.sparkSession, f"{at}/wide")
    return lines, classes


def candidates(classes: DataFrame, turn: int = 0, rounds: int = 1) -> DataFrame:
    """(a, b): classes that the filters don't keep apart, each pair at least once at its first common token, met by the tokens of one round."""
    posts = classes.select("c", "n", "whole", "half", "prefix", F.posexplode("prefix").alias("pos", "tok")).where(F.pmod("tok", F.lit(rounds)) == turn)
    posts = posts.select("tok", "c", "n", "whole", "half", "pos", F.coalesce(F.get("prefix", F.col("pos") - 1), F.lit(-1).cast("long")).alias("before"))
    a, b = posts.alias("a"), posts.alias("b")
    n, m = F.col("a.n"), F.col("b.n")
    same = F.col("a.tok") == F.col("b.tok")
    # The smaller set stands on the left, where the tokens that a set of its own size has to share are few enough.
    order = (n < m) | ((n == m) & (F.col("a.c") < F.col("b.c")))
    short = F.col("a.pos") <= n - needed(n, n)
    lengths = n * DEN >= m * NUM
    need = needed(n, m)
    positions = F.least(n - F.col("a.pos"), m - F.col("b.pos")) >= need
    first = (F.col("a.before") != F.col("b.before")) | (F.col("a.before") == -1)
    whole, half = (F.col(f"a.{x}").bitwiseXOR(F.col(f"b.{x}")) for x in ("whole", "half"))
    near = F.bit_count(half) + F.bit_count(half.bitwiseXOR(whole)) <= n + m - 2 * need
    met = a.join(b, same & order & short & lengths & positions & first & near)
    return met.select(F.col("a.c").alias("a"), F.col("b.c").alias("b")).distinct()


def all_candidates(classes: DataFrame, at: str) -> DataFrame:
    """The candidates of all rounds, stored; a round's shuffles go before the next one's are written."""
    spark, parts = classes.sparkSession, []
    for k in range(ROUNDS):
        parts.append(store(candidates(classes, k, ROUNDS), f"{at}/pairs-{k}"))
        drop(spark)
    pairs = store(reduce(DataFrame.union, parts).distinct(), f"{at}/pairs")
    drop(spark, *[f"{at}/pairs-{k}" for k in range(ROUNDS)])
    return pairs


def light(rows: DataFrame, size: Column) -> DataFrame:
    """``rows`` (stored), broadcast where the sum of ``size`` says that they are small."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(rows) if total <= BROADCAST_BYTES else rows


def word_sets(docs: DataFrame, places: DataFrame, at: str) -> DataFrame:
    """(c, place, words): the words of the lines at ``places`` (c, first), more than once where a row is repeated."""
    wanted = places.groupBy(F.col("first.doc_id").alias("id"), F.col("first.h").alias("h")).agg(F.collect_list(F.struct("first.line", "c")).alias("want"))
    wanted = light(store(wanted, f"{at}/wanted"), 64 + 32 * F.size("want"))
    own = docs.select("doc_id", text_key(F.col("text")).alias("h"), "text").alias("d")
    both = own.join(wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.id")) & (F.col("d.h") == F.col("w.h")))
    texts = both.select("d.doc_id", "d.h", F.split(_plain(F.col("d.text")), "\n").alias("own"), "want")
    # The lines wanted alone go on. Read twice here, ``own`` stays a column; else the lambda would split the text for each line.
    lines = F.transform("want", lambda w: F.struct(w.c.alias("c"), w.line.alias("line"), F.get("own", w.line).alias("text")))
    each = texts.select("doc_id", "h", F.size("own").alias("n"), lines.alias("lines")).select("doc_id", "h", "n", F.explode("lines").alias("w")).where("w.line < n")
    place = F.struct("doc_id", "h", F.col("w.line").alias("line"))
    return each.select(F.col("w.c").alias("c"), place.alias("place"), F.array_distinct(_words(F.col("w.text"))).alias("words"))


def links(pairs: DataFrame, sets: DataFrame, at: str) -> DataFrame:
    """(c, late, links): of each class that matches others, whether one of them is earlier, and how many they are. Pairs are
    verified in rounds, as they travel with word sets."""
    spark, parts = pairs.sparkSession, []
    for k in range(ROUNDS):
        parts.append(store(verified(pairs.where(F.pmod("b", F.lit(ROUNDS)) == k), sets), f"{at}/found-{k}"))
        drop(spark)
    found = reduce(DataFrame.union, parts)
    ends = F.array(F.struct(F.col("a").alias("c"), F.col("a_late").alias("late")), F.struct(F.col("b").alias("c"), (~F.col("a_late")).alias("late")))
    return found.select(F.explode(ends).alias("x")).groupBy("x.c").agg(F.bool_or("x.late").alias("late"), F.count("*").alias("links"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, a_late): the pairs whose words match, once each."""
    left = sets.select(F.col("c").alias("a"), F.col("place").alias("pa"), F.col("words").alias("wa"))
    right = sets.select(F.col("c").alias("b"), F.col("place").alias("pb"), F.col("words").alias("wb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("wa", "wb")))
    true = both.where(F.col("shared") * DEN >= (F.size("wa") + F.size("wb") - F.col("shared")) * NUM)
    return true.select("a", "b", (F.col("pb") < F.col("pa")).alias("a_late")).distinct()


def matched(docs: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(lines, status), both stored: of each class that has several lines or matches others (k1, k2, first, late, links)."""
    spark = docs.sparkSession
    lines, classes = classes_of(docs, at)
    pairs = all_candidates(classes, at)
    concerned = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
    sets = store(word_sets(docs, classes.select("c", "first").join(concerned, "c"), at), f"{at}/sets", compression="zstd")
    sets = light(sets, 64 + 24 * F.size("words"))  # else every pair carries two sets from task to task
    drop(spark)
    found = classes.select("c", "k1", "k2", "first", "lines").join(links(pairs, sets, at), "c", "left").where("lines > 1 or links > 0")
    status = found.select("k1", "k2", "first", F.coalesce("late", F.lit(False)).alias("late"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    status = store(status, f"{at}/status")
    drop(spark, f"{at}/pairs", f"{at}/sets", f"{at}/classes", *[f"{at}/found-{k}" for k in range(ROUNDS)])
    return lines, status


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_links, kept): kept is the text of the lines that stay; links count other classes that match the document's lines."""
    at = shared_dir(docs.sparkSession)
    lines, status = matched(docs, at)
    judged = lines.join(status, ["k1", "k2"]).dropDuplicates(["doc_id", "h", "line"])
    judged = judged.select("doc_id", "h", "line", (F.col("late") | (F.struct("doc_id", "h", "line") != F.col("first"))).alias("gone"), "links")
    by_row = judged.where("gone or links > 0").groupBy("doc_id", "h").agg(F.collect_list(F.when(F.col("gone"), F.col("line"))).alias("gone"), F.sum("links").alias("links"))
    by_row = light(store(by_row, f"{at}/gone"), 64 + 4 * F.size("gone"))
    drop(docs.sparkSession, f"{at}/lines", f"{at}/status")
    own = docs.select("doc_id", text_key(F.col("text")).alias("h"), F.coalesce("text", F.lit("")).alias("text")).alias("d")
    rows = own.join(by_row.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.h") == F.col("g.h")), "left")
    rows = rows.select("d.doc_id", F.split("d.text", "\n").alias("own"), F.coalesce("g.gone", F.array().cast("array<int>")).alias("gone"), F.coalesce("g.links", F.lit(0).cast("long")).alias("n_links"))
    stay = F.when(F.size("gone") == 0, F.col("own")).otherwise(F.filter("own", lambda x, i: ~F.array_contains("gone", i)))
    return rows.select("doc_id", F.size("own").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), "n_links", F.array_join(stay, "\n").alias("kept"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", "n_links", F.sha2("kept", 256).alias("kept_sha256"))


#: Pairs of word sets that share one of their rarest words, by true counts, are compared in full.
SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents),
w AS (SELECT doc_id, line, x, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(x), '[\x20\x09-\x0D]+'), lambda t: t <> ''))) AS words FROM l),
c AS MATERIALIZED (SELECT words, len(words) AS n, row_number() OVER (ORDER BY words) AS c, min((doc_id, line)) AS first FROM w WHERE len(words) > 0 GROUP BY words),
t AS (SELECT c, n, t, count(*) OVER (PARTITION BY t) AS df FROM (SELECT c, n, unnest(words) AS t FROM c)),
r AS MATERIALIZED (SELECT c, n, t FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY df, t) AS k FROM t) WHERE k <= n - (4 * n + 4) // 5 + 1),
q AS (SELECT DISTINCT a.c AS a, b.c AS b FROM r a JOIN r b ON a.t = b.t AND a.n <= b.n AND a.n * 5 >= b.n * 4 AND (a.n < b.n OR a.c < b.c)),
m AS (SELECT q.a, q.b, x.first AS fa, y.first AS fb, len(list_intersect(x.words, y.words)) AS shared, x.n + y.n AS total FROM q JOIN c x ON x.c = q.a JOIN c y ON y.c = q.b),
s AS (SELECT c, bool_or(late) AS late, count(*) AS links FROM (SELECT a AS c, fb < fa AS late FROM m WHERE shared * 5 >= (total - shared) * 4 UNION ALL SELECT b, fa < fb FROM m WHERE shared * 5 >= (total - shared) * 4) GROUP BY c),
j AS (SELECT w.doc_id, w.line, w.x, len(w.words) > 0 AND (coalesce(s.late, false) OR (w.doc_id, w.line) <> c.first) AS gone, coalesce(s.links, 0) AS links FROM w LEFT JOIN c ON c.words = w.words LEFT JOIN s ON s.c = c.c)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (coalesce(gone, false)) AS BIGINT) AS n_removed, CAST(sum(links) AS BIGINT) AS n_links,
sha256(coalesce(string_agg(x, chr(10) ORDER BY line) FILTER (NOT coalesce(gone, false)), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""
