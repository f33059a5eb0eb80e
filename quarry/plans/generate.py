"""Queries that make a corpus of statements and questions, and check it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import generate
from ..sources.files import tables
from .registry import query

START = "2026-02-02"
_NUMBER = "CAST('0x' || left(md5(concat_ws(':', {})), 7) AS BIGINT) % {}"


def _draw(n, *keys: str) -> str:
    return _NUMBER.format(", ".join(keys), n)


def _personas(spark, d) -> DataFrame:
    """A persona for each customer."""
    return tables(spark, d, "customer").select(F.col("c_name").alias("persona"), F.col("c_custkey").cast("int").alias("number"))


def _slots(spark, d) -> DataFrame:
    """A slot for each nation, with six values."""
    n = tables(spark, d, "nation")
    return n.select(F.lower("n_name").alias("kind"), F.col("n_nationkey").alias("number"), F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit("value "), F.col("n_nationkey").cast("string"), F.lit("/"), i.cast("string"))).alias("values"))


def _fillers(spark, d) -> DataFrame:
    return tables(spark, d, "region").select(F.lower("r_name").alias("filler"))


def _items(spark, d) -> DataFrame:
    """An item for each value of the slot that recommendations are about."""
    values = _slots(spark, d).where("kind = 'nation_3'").select(F.posexplode("values").alias("at", "value"))
    return values.select("value", F.concat(F.lit("item "), F.col("at").cast("string")).alias("item"))


_V = f"""WITH c AS (SELECT c_name AS persona, c_custkey AS number, lower(n_name) AS kind, n_nationkey AS slot, row_number() OVER (PARTITION BY c_name ORDER BY {_draw(1 << 28, "'slot'", "c_name", "lower(n_name)")}, lower(n_name)) - 1 AS place FROM customer CROSS JOIN nation),
r AS (SELECT *, {_draw(6, "'value'", "persona", "kind")} AS first, unnest(range(0, CASE WHEN place < 12 THEN 1 WHEN {_draw(10, "'three'", "persona", "kind")} < 4 THEN 3 ELSE 2 END)) AS version FROM c WHERE place < 22),
v AS (SELECT persona, number, kind, slot, place, version, 'value ' || slot || '/' || (first + version) % 6 AS value, CASE WHEN version = 0 THEN place % 5 WHEN place % 5 = 4 THEN 4 + version ELSE 5 + (place + version - 1) % 5 END AS session FROM r)"""


def _versions(spark, d) -> DataFrame:
    return generate.versions(_personas(spark, d), _slots(spark, d))


@query(f"{_V} SELECT persona, kind, CAST(version AS INTEGER) AS version, value, CAST(session AS INTEGER) AS session, CAST(DATE '{START}' + CAST(session * 9 + number AS INTEGER) AS DATE) AS date FROM v")
def corpus_versions(spark, d):
    v = _versions(spark, d)
    return v.select("persona", "kind", "version", "value", "session", generate.session_date(START, F.col("session"), F.col("number")).alias("date"))


@query(f"""{_V}, t AS (SELECT *, lag(value) OVER (PARTITION BY persona, kind ORDER BY version) AS before, CAST(DATE '{START}' + CAST(session * 9 + number AS INTEGER) AS DATE) AS date FROM v),
f AS (SELECT lower(r_name) AS filler, row_number() OVER (ORDER BY lower(r_name)) - 1 AS f FROM region), n AS (SELECT c_name AS persona, session, CAST(DATE '{START}' + CAST(session * 9 + c_custkey AS INTEGER) AS DATE) AS date, {_draw("(SELECT count(*) FROM region)", "'filler'", "c_name", "session", "nth")} AS f
FROM customer, range(0, 10) s(session), range(1, 5) x(nth))
SELECT persona, CAST(session AS INTEGER) AS session, date, kind, '[' || date || '] ' || persona || ', session ' || session || ': My ' || kind || CASE WHEN version = 0 THEN ' is ' || value ELSE ' is no longer ' || before || ', I moved to ' || value END || '.' AS text FROM t
UNION ALL SELECT persona, CAST(session AS INTEGER), date, NULL, '[' || date || '] ' || persona || ', session ' || session || ': Besides, ' || filler || '.' FROM n JOIN f USING (f)""")
def corpus_statements(spark, d):
    return generate.statements(_versions(spark, d), _personas(spark, d), _fillers(spark, d), START)


_REASONS, _NOTHING, _WRONG = generate.REASONS, generate.NOTHING, generate.UNTRUE
_PLACED = "SELECT persona, '{0}' AS type, kind, {1} AS question, array_to_string(list_concat(list_concat(w[1:p], [right_]), w[p + 1:3]), '; ') AS options, substr('ABCD', CAST(p + 1 AS INTEGER), 1) AS answer, right_ AS answer_text FROM ({2})"
_WHY = f"SELECT persona, kind, {_REASONS!r}[a % 5 + 1] AS right_, [{_REASONS!r}[(a + 1) % 5 + 1], {_REASONS!r}[(a + 2) % 5 + 1], {_REASONS!r}[(a + 3) % 5 + 1]] AS w, {_draw(4, "'REASON'", 'persona', 'kind')} AS p FROM (SELECT persona, kind, {_draw(5, "'reason'", 'persona', 'kind', 'max(version)')} AS a FROM v WHERE version > 0 GROUP BY persona, kind)"
_SUITS = f"SELECT persona, kind, 'item ' || x AS right_, ['item ' || (x + 1) % 6, 'item ' || (x + 2) % 6, 'item ' || (x + 3) % 6] AS w, {_draw(4, "'RECOMMEND'", 'persona', 'kind')} AS p FROM (SELECT persona, kind, CAST(split_part(arg_max(value, version), '/', 2) AS INTEGER) AS x FROM v WHERE kind = 'nation_3' GROUP BY persona, kind)"
_ABSENT = f"SELECT c.persona, c.kind, {_NOTHING!r} AS right_, {_WRONG!r} AS w, {_draw(4, "'UNANSWER'", 'c.persona', 'c.kind')} AS p FROM (SELECT DISTINCT persona, kind FROM c WHERE place >= 22) c"


@query(f"{_V} {_PLACED.format('REASON', chr(39) + 'Why did ' + chr(39) + ' || persona || ' + chr(39) + ' change the ' + chr(39) + ' || kind || ' + chr(39) + '?' + chr(39), _WHY)}")
def corpus_reasons(spark, d):
    return generate.reason_questions(_versions(spark, d), _REASONS).withColumn("options", F.array_join("options", "; "))


@query(f"{_V} {_PLACED.format('RECOMMEND', chr(39) + 'What suits the taste of ' + chr(39) + ' || persona || ' + chr(39) + ' in ' + chr(39) + ' || kind || ' + chr(39) + '?' + chr(39), _SUITS)}")
def corpus_recommendations(spark, d):
    return generate.recommend_questions(_versions(spark, d), _slots(spark, d), _items(spark, d), "nation_3").withColumn("options", F.array_join("options", "; "))


@query(f"{_V} {_PLACED.format('UNANSWER', chr(39) + 'What is the ' + chr(39) + ' || kind || ' + chr(39) + ' of ' + chr(39) + ' || persona || ' + chr(39) + '?' + chr(39), _ABSENT)}")
def corpus_unanswerable(spark, d):
    got = generate.absent_questions(_personas(spark, d), _slots(spark, d), _versions(spark, d), _NOTHING, _WRONG)
    return got.withColumn("options", F.array_join("options", "; "))


_ASK = """SELECT persona, '{0}' AS type, kind, {1} AS question, list_concat(list_concat(w[1:p], [right_]), w[p + 1:3]) AS options, substr('ABCD', CAST(p + 1 AS INTEGER), 1) AS answer, right_ AS answer_text FROM (SELECT persona, kind, {2} AS right_, ({3})[1:3] AS w, {4} AS p FROM o WHERE {5})"""
_ASKED = [
    _ASK.format("FACT", "'What is the ' || kind || ' of ' || persona || '?'", "chain[-1]", "others", _draw(4, "'FACT'", "persona", "kind"), "len(chain) = 1"),
    _ASK.format("CURRENT", "'What is the ' || kind || ' of ' || persona || ' now?'", "chain[-1]", "list_concat(chain[1:1], others)", _draw(4, "'CURRENT'", "persona", "kind"), "len(chain) > 1"),
    _ASK.format("EVOLUTION", "'How did the ' || kind || ' of ' || persona || ' change?'", "array_to_string(chain, ', then ')", "[array_to_string(list_reverse(chain), ', then '), chain[1] || ', then ' || others[1], others[1] || ', then ' || chain[-1]]", _draw(4, "'EVOLUTION'", "persona", "kind"), "len(chain) > 1"),
    _ASK.format("RECOMMEND", "'Which gift suits the ' || kind || ' of ' || persona || '?'", "chain[-1]", "others", _draw(4, "'RECOMMEND'", "persona", "kind"), "place < 4 AND persona NOT IN (SELECT persona FROM o WHERE kind = 'nation_3')"),
]
_TASTES = f"SELECT persona, kind, 'item ' || x AS right_, list_transform([0, 1, 2], lambda j: 'item ' || (x + 1 + (t + j) % 5) % 6) AS w, ({_draw(4, "'RECOMMEND'", 'persona', 'kind')} + t) % 4 AS p FROM (SELECT persona, kind, CAST(split_part(chain[-1], '/', 2) AS INTEGER) AS x FROM o WHERE kind = 'nation_3'), range(0, 4) r(t)"
_ALSO = [
    _PLACED.format("RECOMMEND", "'What suits the taste of ' || persona || ' in ' || kind || '?'", _TASTES),
    _PLACED.format("REASON", "'Why did ' || persona || ' change the ' || kind || '?'", _WHY),
    _PLACED.format("UNANSWER", "'What is the ' || kind || ' of ' || persona || '?'", _ABSENT),
]


@query(f"""{_V}, o AS (SELECT *, list_filter(list_transform(range(0, 6), lambda i: 'value ' || slot || '/' || i), lambda x: NOT list_contains(chain, x)) AS others FROM (SELECT persona, kind, slot, place, list(value ORDER BY version) AS chain FROM v GROUP BY ALL))
SELECT persona, type, kind, question, array_to_string(options, '; ') AS options, answer, answer_text FROM ({" UNION ALL ".join(_ASKED)})
UNION ALL {" UNION ALL ".join(_ALSO)}""")
def corpus_questions(spark, d):
    """All six types of questions."""
    asked = generate.questions(_versions(spark, d), _slots(spark, d), _REASONS, _NOTHING, _WRONG, "nation_3", _items(spark, d))
    return asked.withColumn("options", F.array_join("options", "; "))


@query(f"{_V} SELECT persona, count(*) AS slots, CAST(sum(n) AS BIGINT) AS told, bool_and(n = days) AS dates_differ FROM (SELECT persona, kind, count(*) AS n, count(DISTINCT session) AS days FROM v GROUP BY persona, kind) GROUP BY persona")
def corpus_meta(spark, d):
    """Counts of each persona, and whether every version of a slot has a date of its own."""
    per = generate.chains(_personas(spark, d), _slots(spark, d)).select("persona", F.size("chain").cast("long").alias("n"), F.size(F.array_distinct("sessions")).alias("days"))
    return per.groupBy("persona").agg(F.count("*").alias("slots"), F.sum("n").alias("told"), F.bool_and(F.col("n") == F.col("days")).alias("dates_differ"))
