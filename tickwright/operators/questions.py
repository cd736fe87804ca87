"""Plain-language market questions tagged in batch.

Each tag is a column computed from the text; nothing is looked up row by row.
Company names meet the text by an equality join on words, and only the pairs
that share a word are checked for the exact phrase and its position.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import persist_table

# Number words, day counts of time units, and superlatives.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7,
                "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "fifteen": 15,
                "twenty": 20, "twentyfive": 25, "thirty": 30, "fifty": 50}
UNIT_DAYS = {"day": 1, "d": 1, "week": 7, "wk": 7, "month": 30, "mo": 30, "quarter": 91,
             "qtr": 91, "year": 365, "yr": 365}
SUPERLATIVES = ("top", "best", "worst", "first", "bottom", "biggest", "largest", "highest",
                "lowest", "most", "strongest", "weakest", "leading")
# Words of a company name that do not tell it apart.
NAME_STOP_WORDS = ("inc", "corp", "corporation", "the", "company", "co", "group", "platforms",
                   "incorporated", "holdings", "index")
# What a sector may also be called, in the order tried.
SECTOR_ALIASES = (("tech", "Information Technology"), ("healthcare", "Health Care"),
                  ("health", "Health Care"), ("financial", "Financials"), ("bank", "Financials"),
                  ("energy", "Energy"), ("industrial", "Industrials"), ("utility", "Utilities"),
                  ("utilities", "Utilities"), ("staples", "Consumer Staples"),
                  ("discretionary", "Consumer Discretionary"), ("materials", "Materials"),
                  ("real estate", "Real Estate"), ("communication", "Communication Services"))
# Each question template, its keyword groups (all must hit), and
# how many companies it wants, its weight and its bonus for naming the index.
INTENTS = (
    ("top_volume", (("volume", "traded", "trading", "liquid", "turnover"),
                    ("most", "highest", "biggest", "largest", "top")), 0, 1.0, 0.0),
    ("biggest_winners", (("winner", "winners", "gainer", "gainers", "best", "grew", "growth",
                          "rose", "up", "performer", "performers", "performing", "performance",
                          "return", "returns", "returned", "gain", "gains", "gained", "outperform",
                          "outperformed", "leader", "leaders", "leaderboard", "rank", "ranked",
                          "ranking", "top"),), 0, 1.0, 0.0),
    ("biggest_losers", (("loser", "losers", "decliner", "decliners", "worst", "fell", "dropped",
                         "down", "lost", "lose", "loses", "declined", "underperform",
                         "underperformed", "bottom"),), 0, 1.1, 0.0),
    ("biggest_drawdown", (("drawdown", "crash", "collapse", "fell furthest", "decline"),
                          ("biggest", "largest", "worst", "deepest", "most")), 0, 1.4, 0.0),
    ("most_volatile", (("volatile", "volatility", "risky", "riskiest", "swing", "swings"),),
     0, 1.0, 0.0),
    ("safest", (("safest", "stable", "steadiest", "least volatile", "calmest"),), 0, 1.0, 0.0),
    ("best_cagr", (("cagr", "compound", "compounded", "annualized", "annual growth"),), 0, 1.3, 0.0),
    ("compare", (("compare", "versus", "vs", "against", "difference between"),), 2, 1.6, 0.0),
    ("company_detail", (("how did", "tell me about", "performance of", "about", "perform",
                         "performed", "performance", "return", "returns", "returned", "doing",
                         "done"),), 1, 1.0, 0.0),
    ("sector", (("sector", "sectors", "industry group"),), 0, 1.3, 0.0),
    ("market_summary", (("market", "overall", "index", "s&p", "sp500", "summary", "breadth"),),
     0, 1.0, 2.0),
)
ENOUGH_SYMBOLS, TOO_FEW_SYMBOLS = 1.5, -1.0
DEFAULT_LIMIT, MAX_LIMIT = 10, 50

# Patterns run on lower-cased text. The leading look-ahead skips a position by
# its first letter before the costlier Unicode word-boundary test.
_NUMBER = r"\d{1,3}|" + "|".join(NUMBER_WORDS)
_BEST = "|".join(SUPERLATIVES)
_COUNT = (rf"(?=[a-z0-9])(?U:\b)(?:(?:{_BEST})(?U:\s)+(?:{_NUMBER})"
          rf"|(?:{_NUMBER})(?U:\s)+(?:{_BEST}))(?U:\b)")
_COUNT_PART = rf"^(?:(?:{_BEST})[^a-z0-9]+)?([a-z0-9]+)"
_LONG_NUMBER = r"(?U)\d{4}"
_LONG_COUNT = rf"(?U)\b(?:(?:{_BEST})\s+\d{{4,}}|\d{{4,}}\s+(?:{_BEST}))\b"
_LOOKBACK = (r"(?=[lptoiwd])(?U:\b)(?:last|past|previous|trailing|over|in|within|during)(?U:\s)+"
             r"(?:the(?U:\s)+)?(?:last(?U:\s)+|past(?U:\s)+|previous(?U:\s)+)?"
             rf"(?:{_NUMBER})?(?U:\s)*(?:{'|'.join(UNIT_DAYS)})s?(?U:\b)")
_LOOKBACK_PARTS = rf"({_NUMBER})?(?U:\s)*({'|'.join(UNIT_DAYS)})s?$"
_YEAR = r"(?=[12])(?U:\b)(?:19|20)\d{2}(?U:\b)"


def scanned(questions: DataFrame) -> DataFrame:
    """Questions plus what the patterns found, each text scanned once per pattern.

    The later steps read the parts of these short matches, which are columns so that
    none is taken apart twice, and never the text again.
    """
    return (questions.withColumn("_low", F.lower("text"))
            .withColumns({"_count": F.regexp_extract("_low", _COUNT, 0),
                          "_back": F.regexp_extract("_low", _LOOKBACK, 0),
                          "_year": F.regexp_extract("_low", _YEAR, 0)})
            .withColumns({"_count": F.regexp_extract("_count", _COUNT_PART, 1),
                          "_times": F.regexp_extract("_back", _LOOKBACK_PARTS, 1),
                          "_unit": F.regexp_extract("_back", _LOOKBACK_PARTS, 2)}))


def _lookup(table, key: Column) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), key)


def _number(token: Column) -> Column:
    """A number word or digits; only digits are cast, as a cast that fails costs far more than one that does not."""
    return F.coalesce(_lookup(NUMBER_WORDS, token), F.when(token != "", token.try_cast("int")), F.lit(0))


def stated_year() -> Column:
    """The first year of the 1900s or 2000s in the text, 0 when there is none."""
    return F.coalesce(F.when(F.col("_year") != "", F.col("_year").try_cast("int")), F.lit(0))


def stated_count() -> Column:
    """"top 5" or "five best" as a number, 0 when no count is stated."""
    return _number(F.col("_count"))


def stated_lookback() -> Column:
    """"past 3 years" in days; a bare "last year" is one of them; 0 when not stated."""
    times = F.greatest(_number(F.col("_times")), F.lit(1))
    return F.when(F.col("_back") == "", 0).otherwise(times * _lookup(UNIT_DAYS, F.col("_unit")))


def _first_of(conditions_and_values) -> Column:
    picked = F.lit("")
    for condition, value in reversed(list(conditions_and_values)):
        picked = F.when(condition, value).otherwise(picked)
    return picked


def match_sector(value: Column, sectors) -> Column:
    """A loosely named sector as one of the known names, '' when none fits.

    Containment either way comes first, longest name first, then a shared word
    stem. The known names are a short plan-time list.
    """
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    names = sorted(sectors, key=lambda s: (-len(s), list(sectors).index(s)))

    def contains(name):
        low = F.lit(name.lower())
        return F.contains(low, v) | F.contains(v, low)

    def stem(name):
        hit = F.lit(False)
        for word in name.lower().split():
            hit = hit | F.startswith(F.lit(word), v) | v.startswith(word)
        return hit

    rules = [(contains(n), n) for n in names] + [(stem(n), n) for n in names]
    return F.when(v == "", "").otherwise(_first_of(rules))


def stated_sector(sectors) -> Column:
    """The sector a text names, by its full name or by an alias.

    What a name stands for among the known ones is settled when the query is planned.
    """
    low = F.coalesce("_low", F.lit(""))
    names = sorted(sectors, key=lambda s: (-len(s), list(sectors).index(s)))
    rules = [(F.contains(low, F.lit(n.lower())), n) for n in names]
    rules += [(low.contains(alias) & low.rlike(rf"(?U)\b{alias}"), n) for alias, n in SECTOR_ALIASES if n in sectors]
    return _first_of((hit, match_sector(F.lit(n), sectors)) for hit, n in rules)


def tag_year(questions):
    return scanned(questions).select("question_id", stated_year().alias("year"))


def tag_count(questions):
    return scanned(questions).select("question_id", stated_count().alias("stated_count"))


def tag_lookback(questions):
    return scanned(questions).select("question_id", stated_lookback().alias("lookback_days"))


def tag_sector(questions, sectors):
    return scanned(questions).select("question_id", stated_sector(sectors).alias("sector"))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)(\w+)"), F.lit(1))


def _phrases(directory):
    """(word, phrase, words, symbol): what names each company, keyed by the phrase's first word."""
    tokens = F.filter(F.split(F.lower("name"), r"[\s,.]+"),
                      lambda t: (F.length(t) >= 3) & ~t.isin(list(NAME_STOP_WORDS)))
    said = F.array(F.lower("symbol"), F.get(tokens, 0))
    phrases = directory.select("symbol", F.explode(F.array_distinct(said)).alias("phrase"))
    words = words_of(F.col("phrase"))
    return phrases.filter(F.col("phrase").isNotNull()).select(
        "symbol", "phrase", F.get(words, F.lit(0)).alias("word"), F.size(words).alias("words")) \
        .filter(F.col("word") != "")


def symbol_mentions(questions, directory) -> DataFrame:
    """(question_id, symbol, pos): the word at which each company is first named.

    A text is cut once into words, each with the stretch of text that the longest
    name reaches from there; the text itself goes no further. Words that begin no
    name are left out, and a word that a question repeats is one row, before the join
    on the word. A name of several words must follow letter by letter.

    The names are written once, so that Spark knows their size before it plans: while
    they are few, words meet them where they are and only those that begin a name are
    shuffled, once, by question.
    """
    phrases = persist_table(_phrases(directory), "phrases")
    reach = phrases.agg(F.coalesce(F.max("words"), F.lit(1))).first()[0]
    low = F.lower("text")
    if reach > 1:
        chunks = F.regexp_extract_all(low, F.lit(r"(?U)(\w+\W*)"), F.lit(1))
        spoken = (questions.select("question_id", chunks.alias("chunks"), words_of(low).alias("words"))
                  .select("question_id", F.posexplode(F.transform("words", lambda w, i: F.struct(
                      w.alias("word"), F.array_join(F.slice("chunks", i + 1, F.lit(reach)), "").alias("from_here"))))
                      .alias("i", "at"))
                  .select("question_id", "i", "at.word", "at.from_here"))
    else:
        spoken = (questions.select("question_id", F.posexplode(words_of(low)).alias("i", "word"))
                  .withColumn("from_here", F.lit("")))
    named = (spoken.join(phrases.select("word").distinct(), "word", "left_semi").repartition("question_id")
             .groupBy("question_id", "word", "from_here").agg(F.min("i").alias("pos")))
    follows = F.regexp("from_here", F.concat(F.lit(r"(?U)^\Q"), F.col("phrase"), F.lit(r"\E\b")))
    return (named.join(phrases, "word").filter((F.col("phrase") == F.col("word")) | follows)
            .groupBy("question_id", "symbol").agg(F.min("pos").alias("pos")))


def tag_symbols(questions, directory) -> DataFrame:
    """Every question with the companies it names, in the order named."""
    found = symbol_mentions(questions, directory).groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "symbol"))).alias("hits"))
    none = F.array().cast("array<string>")
    return (questions.join(found, "question_id", "left")
            .withColumn("symbols", F.coalesce(F.transform("hits", lambda h: h["symbol"]), none))
            .drop("hits"))


def _keyword_index() -> tuple[str, dict, list]:
    """(pattern, mask of groups by keyword, mask of groups by template).

    A group of a template is one bit. The pattern finds, at every word, the longest
    keyword that starts there; its mask holds those of the shorter ones it begins with.
    """
    groups = [(i, g) for i, (_, own, *_) in enumerate(INTENTS) for g in own]
    said: dict = {}
    for bit, (_, group) in enumerate(groups):
        for keyword in group:
            said[keyword] = said.get(keyword, 0) | 1 << bit
    masks = {k: reduce(lambda a, b: a | b, [m for short, m in said.items() if k == short or k.startswith(short + " ")])
             for k in said}
    need = [sum(1 << bit for bit, (j, _) in enumerate(groups) if j == i) for i in range(len(INTENTS))]
    longest_first = sorted(said, key=lambda k: (-len(k), k))
    starts = "".join(sorted({k[0] for k in said}))
    return rf"(?U)(?=[{starts}])\b(?=({'|'.join(longest_first)})\b)", masks, need


_KEYWORDS, _MASKS, _NEEDED = _keyword_index()


def score_intents(tagged: DataFrame, index_symbol: str) -> DataFrame:
    """The best fitting template of each question, '' when nothing fits.

    The text is scanned once, by one pattern of all keywords; what it says of each group
    of each template is one number. The highest score wins and the earlier template wins
    a tie.
    """
    low, n, said = F.col("_low"), F.size("symbols"), F.col("_said")
    only_index = (n == 1) & (F.get("symbols", F.lit(0)) == index_symbol)
    options = []
    for i, ((name, groups, needs, weight, bonus), need) in enumerate(zip(INTENTS, _NEEDED)):
        score = F.lit(len(groups) * weight)
        if needs:
            score = score + F.when(n >= needs, ENOUGH_SYMBOLS).otherwise(TOO_FEW_SYMBOLS)
        if bonus:
            score = score + F.when(only_index, bonus).otherwise(0.0)
        options.append(F.when((said.bitwiseAND(F.lit(need)) == need) & (score > 0), F.struct(
            score.alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("intent"))))
    found = F.array_distinct(F.regexp_extract_all(low, F.lit(_KEYWORDS), F.lit(1)))
    masks = F.aggregate(found, F.lit(0), lambda m, k: m.bitwiseOR(F.coalesce(_lookup(_MASKS, k), F.lit(0))))
    bare = F.when((n > 0) & (low != ""), "company_detail").otherwise("")
    return (tagged.withColumn("_low", F.lower(F.trim("text")))
            .withColumn("_said", masks).withColumn("_best", F.array_max(F.array(*options)))
            .select(*tagged.columns, F.coalesce("_best.intent", bare).alias("intent"),
                    F.coalesce("_best.score", F.lit(0.0)).alias("score")))


def resolve_params(tagged: DataFrame, start, end, data_min, data_max, sectors,
                   default_limit: int = DEFAULT_LIMIT, max_limit: int = MAX_LIMIT) -> DataFrame:
    """What each question asks for: the question first, then the default window.

    Columns asked_start, asked_end, asked_limit, asked_sector, asked_metric and
    asked_ordering, where the table has them, hold what a question's parsed form
    states and win over its text. Explicit dates beat a stated lookback, and that a
    stated year; a missing or unreadable end of an explicit window is that of the data.
    Windows run back from the newest session and are clamped to the data. Each value
    says where it came from.
    default_limit rows are given when no count is stated and max_limit at most;
    limit_note says `cut` when that changed a stated count and `unreadable` when a
    count has more digits than are read.
    """
    d = {k: F.lit(v).cast("date") for k, v in
         (("start", start), ("end", end), ("min", data_min), ("max", data_max))}

    def clamp(day):
        return F.greatest(d["min"], F.least(day, d["max"]))

    def asked(name, kind="string"):
        return F.col(f"asked_{name}").cast(kind) if f"asked_{name}" in tagged.columns else F.lit(None).cast(kind)

    plain = [c for c in tagged.columns if not c.startswith("asked_")]
    since, until = (F.nullif(F.trim(asked(n)), F.lit("")) for n in ("start", "end"))
    ordering = F.lower(F.trim(asked("ordering")))
    cols = scanned(tagged).select(
        *plain, F.coalesce(F.when(asked("limit", "int") > 0, asked("limit", "int")), stated_count()).alias("stated"),
        stated_lookback().alias("lookback"), stated_year().alias("year"),
        F.coalesce(F.nullif(match_sector(asked("sector"), sectors), F.lit("")), stated_sector(sectors)).alias("sector"),
        (F.col("_low").rlike(_LONG_NUMBER) & F.col("_low").rlike(_LONG_COUNT)).alias("long_count"), since.alias("since"), until.alias("until"),
        F.coalesce(F.lower(F.trim(asked("metric"))), F.lit("")).alias("metric"),
        F.when(ordering.isin("asc", "desc"), ordering).otherwise("").alias("ordering"))
    back, year, stated = F.col("lookback"), F.col("year"), F.col("stated")
    explicit = F.col("since").isNotNull() | F.col("until").isNotNull()
    january = F.when(year > 0, F.make_date(year, F.lit(1), F.lit(1)))

    def day(name, otherwise):
        return clamp(F.coalesce(F.try_to_date(name, "yyyy-MM-dd"), d[otherwise]))

    def source(found, otherwise):
        return F.when(found, "question").otherwise(otherwise)

    return cols.select(
        *plain,
        F.when(explicit, day("since", "min")).when(back > 0, clamp(F.date_sub(d["max"], back)))
        .when(year > 0, clamp(january)).otherwise(d["start"]).alias("start_date"),
        F.when(explicit, day("until", "max")).when(back > 0, d["max"]).otherwise(d["end"]).alias("end_date"),
        F.when(stated > 0, F.least(stated, F.lit(max_limit))).otherwise(default_limit).alias("row_limit"),
        F.when(stated > max_limit, "cut").when(F.col("long_count") & (stated == 0), "unreadable")
        .otherwise("").alias("limit_note"), "sector", "metric", "ordering",
        source(explicit | (back > 0) | (year > 0), "window").alias("window_source"),
        source(stated > 0, "default").alias("limit_source"),
        source(F.col("sector") != "", "default").alias("sector_source"),
        source(F.size("symbols") > 0, "default").alias("symbols_source"),
        source(F.col("metric") != "", "default").alias("metric_source"),
        source(F.col("ordering") != "", "default").alias("ordering_source"))
