"""Instant answers: calculator, units, dates, dictionary and entities for a batch of queries."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomsearch.functions.text import capitalise
from loomsearch.functions.vectorised import vectorised

# Metres of each length unit.
METRES = {1.0: "m meter meters", 1000.0: "km kilometer kilometers", 0.01: "cm centimeter centimeters", 0.001: "mm millimeter millimeters", 1609.34: "mi mile miles", 0.3048: "ft foot feet", 0.0254: "in inch inches"}
UNIT = {name: factor for factor, names in METRES.items() for name in names.split()}
MONTHS = "january february march april may june july august september october november december".split()
ANSWER = "type string, answer string, details string, confidence double"
#: Answers for a few words and names when the knowledge tables have none. (part of speech, definition)
WORDS = {
    "algorithm": ("noun", "A finite list of exact steps that solves a class of problems."),
    "rust": ("noun", "A compiled language that checks memory safety; also the oxide that forms on iron."),
    "search": ("verb", "To look for something, as in a collection of documents."),
    "index": ("noun", "A structure that leads from terms to the documents that hold them."),
    "pagerank": ("noun", "A score of a page from the scores of the pages that link to it."),
    "crawl": ("noun", "A systematic visit of pages by following their links."),
    "crawler": ("noun", "A program that visits pages by following their links."),
    "query": ("noun", "What someone asks of a search engine or a database."),
    "latency": ("noun", "The time from a request to its answer."),
    "semantic": ("adjective", "About meaning rather than form."),
    "embedding": ("noun", "A vector that places a text near others of like meaning."),
    "boilerplate": ("noun", "Text that repeats on many pages and is not their content."),
    "tokenize": ("verb", "To cut text into the units that a program works on."),
    "tokenization": ("noun", "Cutting text into the units that a program works on."),
}
ENTITIES = {
    "rust": ("Rust", "Programming Language", "A compiled language with checked memory safety."),
    "rust programming language": ("Rust", "Programming Language", "A compiled language with checked memory safety."),
    "linux": ("Linux", "Operating System Kernel", "A free kernel begun in 1991."),
    "wikipedia": ("Wikipedia", "Online Encyclopedia", "A free encyclopedia written by volunteers."),
    "canada": ("Canada", "Country", "A country in North America; its capital is Ottawa."),
    "google": ("Google", "Technology Company", "A company known for its search engine."),
    "python": ("Python", "Programming Language", "A general-purpose language with readable syntax."),
    "python programming language": ("Python", "Programming Language", "A general-purpose language with readable syntax."),
}

NUMBER = re.compile(r"\s*(\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+|\d+(?:[eE][+-]?\d+)?|[-+*/%^()])")


def evaluate(text: str) -> int | float:
    """A calculator: + - * / % ^, brackets, signs. Whole numbers divide without remainder; ^ gives a float. ValueError where it is no sum."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = NUMBER.match(text, at)
        if not m:
            raise ValueError(text)
        tokens.append(m[1])
        at = m.end()
    tokens.append("")
    tokens.reverse()

    def whole(x: float) -> int:
        if not -(2**63) <= x < 2**63:
            raise ValueError("out of range")
        return x

    def combine(op: str, a, b):
        ints = isinstance(a, int) and isinstance(b, int)
        if op in "+-*":
            r = a + b if op == "+" else a - b if op == "-" else a * b
            return whole(r) if ints else r
        if b == 0 and ints:
            raise ValueError("division by zero")
        if op == "/":
            if ints:
                return whole(abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1))
            return a / b if b else float("nan")
        sign = -1 if a < 0 else 1
        return sign * (abs(a) % abs(b)) if b else float("nan")

    def level(ops: str, below):
        def run():
            left = below()
            while tokens[-1] and tokens[-1] in ops:
                op = tokens.pop()
                left = combine(op, left, below())
            return left

        return run

    def unit():
        t = tokens.pop()
        if t == "(":
            inner = total()
            if tokens.pop() != ")":
                raise ValueError("a bracket is not closed")
            return inner
        if t == "-":
            return -power()
        if not t or t in "+*/%^)":
            raise ValueError(text)
        return whole(int(t)) if t.isdigit() else float(t)

    def power():
        left = unit()
        while tokens[-1] == "^":
            tokens.pop()
            left = float(left) ** float(unit())
            if isinstance(left, complex):
                raise ValueError("not a real number")
        return left

    total = level("+-", level("*/%", power))
    out = total()
    if tokens[-1]:
        raise ValueError(text)
    return out


def calculate(query: str | None) -> tuple[str, str] | None:
    """(sum, result) or None."""
    text = query or ""
    for cue in ("what is", "calculate", "compute", "="):
        text = text.replace(cue, "")
    text = text.strip()
    if not text:
        return None
    try:
        value = evaluate(text)
    except (ValueError, OverflowError, ZeroDivisionError, RecursionError, IndexError):
        return None
    if isinstance(value, int):
        return text, str(value)
    if value != value or abs(value) == float("inf"):
        return None
    return text, str(int(value)) if value == int(value) and abs(value) < 1e15 else f"{value:.6f}".rstrip("0").rstrip(".")


@vectorised("expression string, result string")
def calculator(query: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([calculate(q) or (None, None) for q in query], columns=["expression", "result"])


def answer(kind: str, text: Column, details: Column, sure: Column | float) -> Column:
    sure = sure if isinstance(sure, Column) else F.lit(sure)
    return F.when(text.isNotNull(), F.struct(F.lit(kind).alias("type"), text.alias("answer"), details.alias("details"), sure.alias("confidence")))


def calculation(query: Column) -> Column:
    x = calculator(query)
    return answer("Calculation", F.concat(x["expression"], F.lit(" = "), x["result"]), F.to_json(x), 0.95)


def units(query: Column) -> Column:
    """Length conversion: number unit in|to unit; the first in or to must be the third word or later."""
    parts = F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda w: w != "")
    at = F.array_min(F.filter(F.transform(parts, lambda w, i: F.when(w.isin("in", "to"), i)), lambda i: i.isNotNull()))
    value = F.try_element_at(parts, F.lit(1)).try_cast("double")
    start = F.array_join(F.slice(parts, 2, F.greatest(at - 1, F.lit(0))), " ")
    end = F.array_join(F.slice(parts, F.coalesce(at, F.lit(0)) + 2, F.size(parts)), " ")
    table = F.create_map(*[x for u, f in UNIT.items() for x in (F.lit(u), F.lit(f))])
    result = F.when((at >= 2) & (at < F.size(parts) - 1), value * table[start] / table[end])
    text = F.concat(F.regexp_replace(value.cast("string"), r"\.0$", ""), F.lit(" "), start, F.lit(" = "), F.format_string("%.4f", result), F.lit(" "), end)
    return answer("UnitConversion", F.when(result.isNotNull(), text), F.to_json(F.struct(value.alias("value"), start.alias("from_unit"), end.alias("to_unit"), result.alias("result"))), 0.90)


def days_in_month(query: Column, today: Column) -> Column:
    """(days) for days in <month> [year], null otherwise."""
    low = F.lower(query)
    tail = F.trim(F.regexp_extract(low, r"^(?:how many )?days in (.*)$", 1))
    parts = F.split(tail, r"\s+")
    name = parts[0]
    month = F.when(name.rlike(r"^\d{1,9}$"), name.try_cast("int"))
    for k, m in enumerate(MONTHS, 1):
        short = [m, m[:3]] + (["sept"] if k == 9 else [])
        month = F.when(name.isin(short), F.lit(k)).otherwise(month)
    year = F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(2)).try_cast("int")).otherwise(F.year(today))
    return F.when((tail != "") & month.between(1, 12) & year.between(1, 9998), F.day(F.last_day(F.make_date(year, F.when(month.between(1, 12), month), F.lit(1)))))


def target_date(query: Column, today: Column) -> Column:
    """The day that a days-until query means: the next holiday, or its last date YYYY-MM-DD or MM/DD/YYYY."""
    low, year = F.lower(query), F.year(today)

    def coming(month: int, day: int) -> Column:
        own = F.make_date(year, F.lit(month), F.lit(day))
        return F.when(own >= today, own).otherwise(F.make_date(year + 1, F.lit(month), F.lit(day)))

    dates = F.regexp_extract_all(low, F.lit(r"(?:^|\s)(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{4})(?=\s|$)"), F.lit(1))
    last = F.try_element_at(dates, F.lit(-1))
    given = F.coalesce(F.try_to_date(last, "yyyy-M-d"), F.try_to_date(last, "M/d/yyyy"))
    return F.when(low.contains("christmas"), coming(12, 25)).when(low.contains("new year"), F.make_date(year + 1, F.lit(1), F.lit(1))).when(low.contains("halloween"), coming(10, 31)).when(low.contains("valentine"), coming(2, 14)).otherwise(given)


def _long_date(day: Column) -> Column:
    return F.concat(F.date_format(day, "MMMM "), F.lpad(F.day(day).cast("string"), 2, " "), F.date_format(day, ", yyyy"))


def dates(query: Column, now: Column) -> Column:
    """Clock, date, days until, days in a month, epoch; in this order."""
    low, today = F.lower(query), F.to_date(now)
    clock = F.concat(F.date_format(now, "hh:mm a, EEEE "), _long_date(now))
    calendar = F.concat(F.date_format(now, "EEEE, "), _long_date(now))
    target = target_date(query, today)
    diff = F.datediff(target, today)
    until = F.when(diff > 0, F.concat(diff.cast("string"), F.lit(" days from now ("), _long_date(target), F.lit(")"))).when(diff == 0, F.concat(F.lit("That's today! ("), _long_date(target), F.lit(")"))).when(diff < 0, F.concat((-diff).cast("string"), F.lit(" days ago ("), _long_date(target), F.lit(")")))
    days = days_in_month(query, today)
    tail = F.trim(F.regexp_extract(low, r"^(?:how many )?days in (.*)$", 1))
    epoch = F.unix_seconds(now)
    kind = "DateTime"
    is_clock = low.contains("what time") | low.contains("current time") | low.contains("time now") | (low == "time")
    is_date = low.contains("what day") | low.contains("today") | low.contains("current date") | low.contains("what is the date") | (low == "date")
    is_until = (low.contains("days until") | low.contains("days to")) & target.isNotNull()
    is_epoch = low.contains("unix timestamp") | low.contains("epoch time") | low.contains("unix time")
    iso = F.to_json(F.struct(F.date_format(now, "yyyy-MM-dd").alias("iso")))
    return (
        F.when(is_clock, answer(kind, clock, iso, 0.95))
        .when(is_date, answer(kind, calendar, iso, 0.95))
        .when(is_until, answer(kind, until, F.to_json(F.struct(diff.alias("days"), target.cast("string").alias("target_date"))), 0.90))
        .when(days.isNotNull(), answer(kind, F.concat(capitalise(tail), F.lit(" has "), days.cast("string"), F.lit(" days")), F.to_json(F.struct(tail.alias("month"), days.alias("days"))), 0.92))
        .when(is_epoch, answer(kind, F.concat(F.lit("Current Unix timestamp: "), epoch.cast("string")), F.to_json(F.struct(epoch.alias("timestamp"))), 0.95))
    )


def asked_word(query: Column) -> Column:
    """The word that a dictionary query asks for, null where it is none; up to three words."""
    low = F.lower(query)
    word = F.trim(F.coalesce(F.nullif(F.regexp_extract(low, r"^(?:define|definition of|meaning of) (.*)$", 1), F.lit("")), F.nullif(F.regexp_extract(low, r"^what does (.*) mean$", 1), F.lit(""))))
    return F.when((word != "") & (F.size(F.split(word, r"\s+")) <= 3), word)


def asked_entity(query: Column) -> Column:
    low = F.lower(F.trim(query))
    name = F.coalesce(*[F.nullif(F.trim(F.regexp_extract(low, p, 1)), F.lit("")) for p in (r"^who (?:is|was) (.*)$", r"^what is (?!the |a )(.*)$", r"^tell me about (.*)$")])
    return F.regexp_replace(name, r"\?$", "")


def define(queries: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """(query_id, a): dictionary answers, from the table (word, part_of_speech, definition, example) first."""
    spark = queries.sparkSession
    built = spark.createDataFrame([(w, p, d, 0.85, 1) for w, (p, d) in WORDS.items()], "word string, pos string, definition string, sure double, place int")
    if definitions is not None:
        built = built.unionByName(definitions.select(F.lower("word").alias("word"), F.col("part_of_speech").alias("pos"), "definition", F.lit(0.88).alias("sure"), F.lit(0).alias("place")))
    asked = queries.select("query_id", asked_word(F.col("text")).alias("word")).where("word is not null")
    found = asked.join(built, "word")
    first = found.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "definition"))).where("k = 1")
    text = F.concat(F.when(F.coalesce("pos", F.lit("")) != "", F.concat(F.lit("("), "pos", F.lit(") "))).otherwise(""), "definition")
    return first.select("query_id", answer("Dictionary", text, F.to_json(F.struct("word", F.col("pos").alias("part_of_speech"), "definition")), F.col("sure")).alias("a"))


def entity(queries: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """(query_id, a): entity panels; a name matches itself or an alias that holds it."""
    spark = queries.sparkSession
    built = spark.createDataFrame([(k, n, t, d, "", 1) for k, (n, t, d) in ENTITIES.items()], "key string, name string, kind string, description string, aliases string, place int")
    asked = queries.select("query_id", asked_entity(F.col("text")).alias("asked")).where("asked is not null")
    found = asked.join(built, F.col("asked") == F.col("key"))
    if entities is not None:
        own = entities.select(F.lower("name").alias("key"), "name", F.col("entity_type").alias("kind"), "description", F.lower(F.coalesce("aliases", F.lit(""))).alias("aliases"), F.lit(0).alias("place"))
        found = found.unionByName(asked.join(own, (F.col("asked") == F.col("key")) | F.col("aliases").contains(F.col("asked"))))
    first = found.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "name"))).where("k = 1")
    return first.select("query_id", answer("EntityKnowledgePanel", F.concat("kind", F.lit(" — "), "description"), F.to_json(F.struct("name", F.col("kind").alias("type"), "description")), 0.85).alias("a"))


def answers(queries: DataFrame, now: Column, definitions: DataFrame | None = None, entities: DataFrame | None = None, least: float = 0.8) -> DataFrame:
    """queries (query_id, text) with instant: the first answer sure enough, in the order calculator, units, dates, dictionary, entity."""
    own = queries.withColumns({"_c": calculation(F.col("text")), "_u": units(F.col("text")), "_d": dates(F.col("text"), now)})
    own = own.join(define(queries, definitions).withColumnRenamed("a", "_w"), "query_id", "left").join(entity(queries, entities).withColumnRenamed("a", "_e"), "query_id", "left")
    sure = [F.when(F.col(c)["confidence"] >= least, F.col(c)) for c in ("_c", "_u", "_d", "_w", "_e")]
    return own.withColumn("instant", F.coalesce(*sure)).drop("_c", "_u", "_d", "_w", "_e")
