"""Registered queries over question texts and the company catalog."""

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import questions as Q
from ..session import scratch_path
from .checks import Check
from .fixtures import INDEX
from .oracle import VIEWS

SECTORS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "Index"]
START, END, DATA_MIN, DATA_MAX = "1997-01-01", "2000-12-31", "1995-01-01", "2001-11-04"

_W = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
_B, _E = r"(?:^|[^\p{L}\p{M}\p{Nd}\p{Pc}])", r"(?:$|[^\p{L}\p{M}\p{Nd}\p{Pc}])"
_NUM = r"\d{1,3}|" + "|".join(Q.NUMBER_WORDS)
_SUP = "|".join(Q.SUPERLATIVES)

VIEWS["v_questions"] = """
SELECT CONCAT('o', CAST(o_orderkey AS VARCHAR)) AS question_id, CASE o_orderkey % 8
  WHEN 0 THEN CONCAT('Compare ', a, ' and ', b, ' since ', y)
  WHEN 1 THEN CONCAT('top ', n, ' Asia companies over the past ', n, ' years')
  WHEN 2 THEN CONCAT('Which stock had the highest trading volume in ', y, '?')
  WHEN 3 THEN CONCAT('five worst performers last ', n, ' quarters')
  WHEN 4 THEN CONCAT('How did ', a, ' Inc perform within the last month')
  WHEN 5 THEN 'Which sector performed best? technology or AFRICA'
  WHEN 6 THEN 'How has the market done over the last twenty wks'
  ELSE CONCAT('biggest drawdown of ', b, ', then ', a) END AS text,
  CASE o_orderkey % 40 WHEN 3 THEN '1996-02-01' WHEN 11 THEN '1990-01-01' WHEN 19 THEN 'soon' END AS asked_start,
  CASE o_orderkey % 80 WHEN 3 THEN '1999-01-31' WHEN 27 THEN '2030-01-01' END AS asked_end,
  CASE o_orderkey % 50 WHEN 4 THEN 7 WHEN 5 THEN 70 END AS asked_limit,
  CASE o_orderkey % 30 WHEN 5 THEN ' Volume ' END AS asked_metric,
  CASE o_orderkey % 30 WHEN 6 THEN 'ASC' WHEN 7 THEN 'sideways' END AS asked_ordering
FROM (SELECT o_orderkey, CONCAT('NATION_', CAST(o_custkey % 25 AS VARCHAR)) AS a,
             CONCAT('nation_', CAST((o_orderkey // 8) % 25 AS VARCHAR)) AS b,
             CAST((o_orderkey // 8) % 60 AS VARCHAR) AS n,
             CAST(1990 + (o_orderkey // 8) % 14 AS VARCHAR) AS y FROM orders)
UNION ALL
SELECT CONCAT('c-', CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR)), text, NULL, NULL, NULL, NULL, NULL FROM conversations
"""


def _case(table, token):
    return "CASE " + token + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 0 END"


def _number(token):
    return (f"CASE WHEN regexp_full_match({token}, '[0-9]+') THEN TRY_CAST({token} AS INTEGER) "
            f"ELSE {_case(Q.NUMBER_WORDS, token)} END")


VIEWS["v_tags"] = f"""
SELECT question_id, text,
  CASE WHEN y = '' THEN 0 ELSE CAST(y AS INTEGER) END AS year,
  CASE WHEN c1 <> '' THEN {_number('c1')} ELSE {_number('c2')} END AS stated_count,
  CASE WHEN unit = '' THEN 0 ELSE GREATEST({_number('times')}, CASE WHEN times = '' OR times = '0' OR times = '00'
       OR times = '000' THEN 1 ELSE 0 END) * {_case(Q.UNIT_DAYS, 'unit')} END AS lookback_days,
  {' '.join(['CASE'] + [f"WHEN CONTAINS(low, '{s.lower()}') THEN '{s}'"
                        for s in sorted(SECTORS, key=lambda s: -len(s))])} ELSE '' END AS sector
FROM (SELECT *, LOWER(text) AS low,
        regexp_extract(text, '{_B}((?:19|20)[0-9]{{2}}){_E}', 1) AS y,
        regexp_extract(LOWER(text), '{_B}(?:(?:{_SUP})\\s+({_NUM})|({_NUM})\\s+(?:{_SUP})){_E}', 1) AS c1,
        regexp_extract(LOWER(text), '{_B}(?:(?:{_SUP})\\s+({_NUM})|({_NUM})\\s+(?:{_SUP})){_E}', 2) AS c2,
        regexp_extract(LOWER(text), '{_B}(?:last|past|previous|trailing|over|in|within|during)\\s+(?:the\\s+)?(?:last\\s+|past\\s+|previous\\s+)?({_NUM})?\\s*({'|'.join(Q.UNIT_DAYS)})s?{_E}', 1) AS times,
        regexp_extract(LOWER(text), '{_B}(?:last|past|previous|trailing|over|in|within|during)\\s+(?:the\\s+)?(?:last\\s+|past\\s+|previous\\s+)?({_NUM})?\\s*({'|'.join(Q.UNIT_DAYS)})s?{_E}', 2) AS unit
      FROM v_questions)
"""
VIEWS["v_said"] = f"""
SELECT question_id, STRING_AGG(symbol, ',' ORDER BY pos, symbol) AS symbols, COUNT(*) AS n FROM (
  SELECT q.question_id, s.symbol, position(' ' || LOWER(s.symbol) || ' ' IN q.norm) AS pos
  FROM (SELECT question_id, ' ' || regexp_replace(LOWER(text), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]', ' ', 'g') || ' ' AS norm
        FROM v_questions) q CROSS JOIN fx_symbols s)
WHERE pos > 0 GROUP BY question_id
"""


def _intent_options():
    rows = []
    for i, (name, groups, needs, weight, bonus) in enumerate(Q.INTENTS):
        hit = " AND ".join(f"regexp_matches(low, '{_B}(?:{'|'.join(g)}){_E}')" for g in groups)
        score = f"{len(groups) * weight}"
        if needs:
            score += f" + CASE WHEN n >= {needs} THEN 1.5 ELSE -1.0 END"
        if bonus:
            score += f" + CASE WHEN symbols = '{INDEX}' THEN {bonus} ELSE 0 END"
        rows.append(f"SELECT question_id, {i} AS k, '{name}' AS intent, CAST({score} AS DOUBLE) AS score "
                    f"FROM v_lowered WHERE {hit}")
    return " UNION ALL ".join(rows)


VIEWS["v_lowered"] = """
SELECT q.question_id, q.text, LOWER(TRIM(q.text)) AS low, COALESCE(s.symbols, '') AS symbols, COALESCE(s.n, 0) AS n
FROM v_questions q LEFT JOIN v_said s ON s.question_id = q.question_id
"""
VIEWS["v_options"] = _intent_options()
VIEWS["v_intent"] = """
SELECT q.question_id, COALESCE(b.intent, CASE WHEN q.n > 0 THEN 'company_detail' ELSE '' END) AS intent,
       COALESCE(b.score, 0) AS score
FROM v_lowered q LEFT JOIN (SELECT question_id, ARG_MIN(intent, (-score, k)) AS intent, MAX(score) AS score
                            FROM v_options WHERE score > 0 GROUP BY question_id) b ON b.question_id = q.question_id
"""
VIEWS["v_terms"] = """
SELECT DISTINCT LOWER(n_name) AS term FROM nation UNION SELECT LOWER(n_name)[1:5] FROM nation
UNION SELECT LOWER(n_name)[5:24] FROM nation UNION SELECT ' inc ' UNION SELECT LOWER(r_name) FROM region
JOIN nation ON n_regionkey = r_regionkey UNION SELECT LOWER(o_orderpriority) FROM orders
"""
VIEWS["v_catalog"] = """
SELECT symbol, name, '' AS exchange, 0 AS source FROM fx_symbols WHERE is_index = 0
UNION ALL SELECT symbol, name, exchange, 1 FROM fx_universe WHERE symbol NOT IN (SELECT symbol FROM fx_symbols WHERE is_index = 0)
"""


def _core(f):
    """The core dimension without one sector, so both dimensions matter."""
    return f.symbols.filter("sector <> 'ASIA'")


_CORE_CATALOG = VIEWS["v_catalog"].replace("is_index = 0", "is_index = 0 AND sector <> 'ASIA'")
VIEWS["v_mixed"] = _CORE_CATALOG


def _stored_index(f):
    """The catalog's index, written in two versions: the second corrects companies of the first."""
    catalog, path = C.dedupe_catalog(_core(f), f.universe), scratch_path(f.spark, "search-index")
    stale = F.col("symbol").endswith("1")
    C.write_index(catalog.withColumn("name", F.when(stale, F.concat(F.lit("old "), "name")).otherwise(F.col("name"))), path, 1)
    return C.write_index(catalog.filter(stale), path, 2)


def _tagged(f):
    return Q.tag_symbols(f.questions, f.symbols)


CHECKS = [
    Check("dedupe_catalog", "symbol name exchange source#",
          lambda f: C.dedupe_catalog(_core(f), f.universe), "SELECT * FROM v_mixed"),
    Check("union_catalog", "symbol name exchange source#",
          lambda f: C.union_catalog(_core(f), f.universe),
          """SELECT symbol, name, '' AS exchange, 0 AS source FROM fx_symbols WHERE is_index = 0 AND sector <> 'ASIA'
             UNION ALL SELECT symbol, name, exchange, 1 FROM fx_universe"""),
    Check("search_catalog", "term rank# symbol name exchange tier#",
          lambda f: C.search_index(_stored_index(f), f.terms, 8),
          """SELECT term, ROW_NUMBER() OVER (PARTITION BY term ORDER BY tier, source, symbol) AS rank, symbol, name,
                    COALESCE(NULLIF(exchange, ''), 'local') AS exchange, tier
             FROM (SELECT term, symbol, name, exchange, source, CASE WHEN UPPER(symbol) = t THEN 0
                     WHEN STARTS_WITH(UPPER(symbol), t) OR STARTS_WITH(UPPER(name), t) THEN 1 ELSE 2 END AS tier
                   FROM (SELECT term, UPPER(TRIM(term)) AS t FROM v_terms) JOIN v_mixed
                     ON CONTAINS(UPPER(symbol), t) OR CONTAINS(UPPER(name), t))
             QUALIFY rank <= 8"""),
    Check("tag_year", "question_id year#", lambda f: Q.tag_year(f.questions), "SELECT * FROM v_tags"),
    Check("tag_count", "question_id stated_count#", lambda f: Q.tag_count(f.questions), "SELECT * FROM v_tags"),
    Check("tag_lookback", "question_id lookback_days#", lambda f: Q.tag_lookback(f.questions),
          "SELECT * FROM v_tags"),
    Check("tag_sector", "question_id sector", lambda f: Q.tag_sector(f.questions, SECTORS),
          "SELECT * FROM v_tags"),
    Check("tag_symbols", "question_id symbols",
          lambda f: _tagged(f).withColumn("symbols", F.concat_ws(",", "symbols")),
          "SELECT question_id, symbols FROM v_lowered"),
    Check("score_intents", "question_id intent score~4",
          lambda f: Q.score_intents(_tagged(f), INDEX), "SELECT * FROM v_intent"),
    Check("resolve_params", "question_id start_date@ end_date@ row_limit# limit_note sector metric ordering "
          "window_source limit_source sector_source symbols_source metric_source ordering_source",
          lambda f: Q.resolve_params(_tagged(f), START, END, DATA_MIN, DATA_MAX, SECTORS),
          f"""SELECT question_id,
                CASE WHEN explicit THEN GREATEST(DATE '{DATA_MIN}', LEAST(COALESCE(TRY_CAST(asked_start AS DATE), DATE '{DATA_MIN}'), DATE '{DATA_MAX}'))
                     WHEN lookback_days > 0 THEN GREATEST(DATE '{DATA_MIN}', DATE '{DATA_MAX}' - CAST(lookback_days AS INTEGER))
                     WHEN year > 0 THEN GREATEST(DATE '{DATA_MIN}', LEAST(make_date(year, 1, 1), DATE '{DATA_MAX}'))
                     ELSE DATE '{START}' END AS start_date,
                CASE WHEN explicit THEN GREATEST(DATE '{DATA_MIN}', LEAST(COALESCE(TRY_CAST(asked_end AS DATE), DATE '{DATA_MAX}'), DATE '{DATA_MAX}'))
                     WHEN lookback_days > 0 THEN DATE '{DATA_MAX}' ELSE DATE '{END}' END AS end_date,
                CASE WHEN stated > 0 THEN LEAST(stated, 50) ELSE 10 END AS row_limit,
                CASE WHEN stated > 50 THEN 'cut' WHEN stated = 0 AND long_count THEN 'unreadable' ELSE '' END AS limit_note,
                sector, metric, ordering,
                CASE WHEN explicit OR lookback_days > 0 OR year > 0 THEN 'question' ELSE 'window' END AS window_source,
                CASE WHEN stated > 0 THEN 'question' ELSE 'default' END AS limit_source,
                CASE WHEN sector <> '' THEN 'question' ELSE 'default' END AS sector_source,
                CASE WHEN n > 0 THEN 'question' ELSE 'default' END AS symbols_source,
                CASE WHEN metric <> '' THEN 'question' ELSE 'default' END AS metric_source,
                CASE WHEN ordering <> '' THEN 'question' ELSE 'default' END AS ordering_source
              FROM v_stated"""),
]
VIEWS["v_stated"] = f"""
SELECT t.question_id, t.lookback_days, t.year, t.sector, l.n, q.asked_start, q.asked_end,
  q.asked_start IS NOT NULL OR q.asked_end IS NOT NULL AS explicit, COALESCE(q.asked_limit, t.stated_count) AS stated,
  COALESCE(LOWER(TRIM(q.asked_metric)), '') AS metric,
  CASE WHEN LOWER(q.asked_ordering) IN ('asc', 'desc') THEN LOWER(q.asked_ordering) ELSE '' END AS ordering,
  regexp_matches(l.low, '{_B}(?:(?:{_SUP})\\s+[0-9]{{4,}}|[0-9]{{4,}}\\s+(?:{_SUP})){_E}') AS long_count
FROM v_tags t JOIN v_lowered l ON l.question_id = t.question_id JOIN v_questions q ON q.question_id = t.question_id
"""
