"""Text cut off by field limits (problem 1).

Two kinds of evidence are put together for each value by one mixture model, fitted by expectation and maximisation.

Length: per source and field two hazards compete at each length, that of the text's own end and that of being cut. A value
that was cut is a right-censored observation of its natural length, one that ended by itself is one of the cut. Both hazards
are fitted by maximum likelihood, in closed form: expected ends over characters at risk, in pieces of BIN characters; and at
candidate limits, lengths that more values have than those around them, cuts at just that length over values at risk. Lists of
headlines are texts of another form, with natural lengths of their own; they are cut at the same limits.

Ending: what was put after a break is taken off (repeated lines of the source, tags and entities that were never closed,
ellipses, "read more", links, tags with #, emoji, the source's name in brackets); then the last signs are classed. A
decimal number that may have lost its digits and a quotation that may go on are classed by how the same words go on elsewhere
in the corpus. How likely each class is among cut values, and among whole ones, is fitted together with the hazards.

The posterior log odds of a value are those of the two hazards at its length and of the two likelihoods of its ending. A value
is a case if they are over 0 and it does not end as a sentence does: a cut that fell on a sentence's end has left no break.

Defined results: null, blank and no-value texts, and texts of additions only, are no cases. Null sources are one source of
their own. Repeated rows give the same verdict. A list of complete headlines counts as complete unless its source cuts at
just its length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions.text import decode_entities, plain_ws, says_nothing, with_line_key
from tidewire.session import step, table, written

#: Width of the hazards' pieces in characters, the count with which rare ones are smoothed, and rounds of the fit.
BIN, SMOOTH, ROUNDS = 16, 0.05, 6
#: What the fit starts from, and counts as PRIOR values of each class: how likely values of a class are cut (others: one in two).
START = {"complete": 0.01, "quote_ends": 0.1, "number_ends": 0.1, "list": 0.1, "quote_goes_on": 0.7, "number_goes_on": 0.7, "open": 0.9, "abbreviation": 0.9}
PRIOR = 1.0
#: From so many values of a source on, a last line counts as added to the texts.
ADDED_LINE = 3

# Abbreviations that a sentence does not end with.
ABBREVIATIONS = "Mr Mrs Ms Dr Prof St Vol No Gov Sen Rep Gen Hon Rev Capt Col Lt Maj Sgt Messrs Mt Ft Dept Fig Jan Feb Aug Sept Oct Nov Dec vs approx".split()

_ELLIPSIS = r"(?:…|\.{3,}|&#8230;|&hellip;)"
_ADDED = (
    r"(?is)(?:\s*(?:"
    + rf"{_ELLIPSIS}|[\[(]\s*{_ELLIPSIS}\s*[\])]?|\((?:more|continued|cont\.?)\)?|»|[-–—]*>+"
    + r"|(?<![\p{L}\p{N}])(?:read more|continue reading|read the full story|full story|see more)(?:\s*[:.»>-]+)?"
    + r"|#[\p{L}\p{N}_]+|https?://\S*|www\.\S+"
    + r"|[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}]+"
    + r"))+\s*\z"
)
_BRACKETED_NAME = r"\s*\((?:\p{Lu}[\p{L}\p{N}'’.&-]*\s?){1,6}\)\s*\z"
_UNCLOSED = r"(?s)\s*(?:<[^<>]*|&(?:#[xX]?[0-9a-fA-F]*|[a-zA-Z]{0,8}))\z"
_END = r"[.!?。！？؟।]['\"”’»)\]]*\z"
_NUMBER = r"(?<!\S)(\S+)\s+([\p{L}\p{Sc}]?\d[\d,]*(?:\.\d+)?)"
_QUOTE_END = r"[.!?]\"\z"


def _values(stories: DataFrame) -> DataFrame:
    fields = F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(n).alias("text")) for n in ("summary", "excerpt")]))
    return stories.select("id", "source_id", fields.alias("x")).select("id", "source_id", "x.field_name", "x.text").where(~says_nothing("text"))


def _without_added_lines(values: DataFrame) -> DataFrame:
    """Values less the last lines that their source adds to many texts (never the longest line of a value)."""
    many = values.where(F.col("text").contains("\n"))
    lines = many.select("*", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n", -1)).alias("no", "line")).drop("text")
    lines = with_line_key(lines, "line", "k").withColumn("k", F.when(F.col("k") != "", F.xxhash64("k")))
    common = lines.where(F.col("k").isNotNull()).groupBy("source_id", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= ADDED_LINE).select(F.col("source_id").alias("s"), F.col("k").alias("h"))
    tagged = F.col("line").rlike(r"^\s*<.*>\s*\z")
    marked = lines.join(common, F.col("source_id").eqNullSafe(F.col("s")) & (F.col("k") == F.col("h")), "left").withColumn("added", F.col("h").isNotNull() | F.col("k").isNull() | tagged)
    whole = marked.groupBy("id", "source_id", "field_name", "t").agg(
        F.array_sort(F.collect_set(F.struct("no", "line", "added"))).alias("x"), F.max_by("no", F.struct(F.length("line"), -F.col("no"))).alias("main")
    )
    last = F.array_max(F.transform(F.filter("x", lambda x: ~x["added"] | (x["no"] == F.col("main"))), lambda x: x["no"]))
    text = F.array_join(F.transform(F.filter("x", lambda x: x["no"] <= last), lambda x: x["line"]), "\n")
    return values.where(~F.col("text").contains("\n")).unionByName(whole.select("id", "source_id", "field_name", text.alias("text")))


def _with_body(values: DataFrame) -> DataFrame:
    """id, source_id, field_name and body: the text without what was put after it. Written once, for all that read it."""
    strip = lambda x: F.regexp_replace(F.when(x.endswith(")"), F.regexp_replace(x, _BRACKETED_NAME, "")).otherwise(x), _ADDED, "")
    a, b, c = F.col("_tw_a"), F.col("_tw_b"), F.col("_tw_c")
    df = step(values, _tw_a=F.rtrim(F.when(F.col("text").contains("<"), F.regexp_replace("text", "<[^<>]+>", "")).otherwise(F.col("text"))))
    open_mark = a.contains("<") | a.contains("&")
    df = step(df, _tw_b=F.rtrim(plain_ws(F.when(open_mark, decode_entities(F.regexp_replace(a, _UNCLOSED, ""))).otherwise(a))))
    # nothing was added to a text that ends with a plain sentence sign
    df = step(df, _tw_c=F.when(~F.substring(b, -2, 2).rlike("[.!?][\"”’]?\\z") | b.endswith("..."), F.rtrim(strip(b))).otherwise(b))
    df = step(df, body=F.when(c != b, F.rtrim(strip(F.rtrim(strip(c))))).otherwise(c))
    return written(df.select("id", "source_id", "field_name", "body"), "bodies")


def _is_list(body: Column) -> Column:
    """Headlines one after another: a lead-in and a colon, parts split by semicolons, each a capitalised phrase of three words or more."""
    parts = F.split(F.regexp_replace(body, r"^[^:;]{2,60}:\s", ""), r";\s+", -1)
    return body.rlike(r"^[^:;.!?]{2,60}:\s") & body.contains("; ") & ~body.rlike(r"[.!?]\s+\p{Lu}") & F.forall(parts, lambda p: p.rlike(r"^[\p{Lu}\p{N}\p{Sc}]\S*(?:\s+\S+){2,}\z"))


def _context(word: Column) -> Column:
    """The word before a number as a context: lower case; after a comma only the comma counts."""
    return F.when(word.endswith(","), ",").otherwise(F.lower(word))


def features(values: DataFrame) -> DataFrame:
    """One row per value, without its text: length of the body, class of its ending, and what the doubtful classes are told by."""
    abbreviation = rf"(?:^|[\s(\"“'])(?:{'|'.join(ABBREVIATIONS)})\.\z"
    body, tail = F.col("body"), F.substring("body", -2, 2)
    odd_quotes = (F.length(body) - F.length(F.replace(body, F.lit('"'), F.lit("")))) % 2 == 1
    kind = (
        F.when(body.endswith(".") & F.substring(body, -12, 12).rlike(abbreviation), "abbreviation")
        .when(_is_list(body), "list")
        .when(~tail.rlike(r"[.!?。！？؟।]\z") & ~(tail.rlike("['\"”’»)\\]]\\z") & body.rlike(_END)), "open")
        .when(tail.rlike(r"\d\."), "number")
        .when(odd_quotes & ~body.endswith('"'), "in_quotes")
        .when(tail.rlike(_QUOTE_END), "quote")
        .otherwise("complete")
    )
    df = step(values.where(body.rlike(r"[\p{L}\p{N}]")), kind=kind)
    # the last number and the word before it, only where they are asked for
    last = lambda i: F.when(F.col("kind") == "number", F.regexp_extract(body, _NUMBER + r"\.\z", i))
    return df.select("id", "source_id", "field_name", F.length(body).alias("len"), "kind", _context(last(1)).alias("word"), F.regexp_replace(last(2), r"\d", "d").alias("shape"), tail.alias("tail"))


def number_contexts(values: DataFrame) -> DataFrame:
    """How numbers go on inside the texts: word before, form (each digit a d) -> times in all, times at a sentence's end."""
    found = values.where(F.col("body").rlike(r"\d")).select(F.explode(F.regexp_extract_all("body", F.lit(_NUMBER + r"(\.?)(?=\s)"), F.lit(0))).alias("x"))
    at = lambda i: F.regexp_extract("x", r"(?s)^(\S+)\s+(.*?)(\.?)\z", i)
    parts = found.select(_context(at(1)).alias("word"), F.regexp_replace(at(2), r"\d", "d").alias("form"), (at(3) == ".").alias("ends"))
    return parts.groupBy("word", "form").agg(F.count(F.lit(1)).alias("n"), F.count_if("ends").alias("n_ends"))


def number_kinds(doubtful: DataFrame, contexts: DataFrame) -> DataFrame:
    """doubtful (word, shape) with number_kind: whether a number like this, after this word, rather goes on or ends a sentence."""
    contexts = contexts.withColumn("stem", F.regexp_replace("form", r"\.d+\z", ""))
    same = contexts.select(F.col("word").alias("w1"), F.col("form").alias("f1"), "n", "n_ends")
    longer = contexts.where(F.col("form") != F.col("stem")).groupBy(F.col("word").alias("w2"), F.col("stem").alias("f2")).agg(F.sum("n").alias("n_longer"))
    known = contexts.groupBy(F.col("form").alias("f3")).agg(F.sum("n").alias("n_form"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    # where such a number ends sentences here, only its decimals speak for a cut; where it never does, all that goes on does
    goes_on = zero("n_longer") + F.when(zero("n_ends") == 0, zero("n")).otherwise(0) + F.when(zero("n_form") == 0, 3).otherwise(0)
    kind = F.when(goes_on > zero("n_ends"), "number_goes_on").when(goes_on < zero("n_ends"), "number_ends").otherwise("number_unknown")
    return (
        doubtful.join(same, (F.col("word") == F.col("w1")) & (F.col("shape") == F.col("f1")), "left")
        .join(longer, (F.col("word") == F.col("w2")) & (F.col("shape") == F.col("f2")), "left")
        .join(known, F.col("shape") == F.col("f3"), "left")
        .select("word", "shape", kind.alias("number_kind"))
    )


def quote_contexts(values: DataFrame) -> DataFrame:
    """After a sentence sign and a closing quotation mark: how often a sentence goes on, and how often a new one begins."""
    found = values.where(F.col("body").contains('"')).select(F.explode(F.regexp_extract_all("body", F.lit(r"[.!?]\"\s+\p{L}"), F.lit(0))).alias("x"))
    on = F.substring("x", -1, 1).rlike(r"\p{Ll}")
    return found.groupBy(F.substring("x", 1, 2).alias("tail")).agg(F.count_if(on).alias("goes_on"), F.count_if(~on).alias("ends"))


def classed(values: DataFrame) -> DataFrame:
    """Every value without its text: id, source_id, field_name, len, kind (of the ending, the doubtful ones told by their contexts)."""
    feats = written(features(values), "truncation")
    kept = ["id", "source_id", "field_name", "len"]
    doubtful = feats.where("kind = 'number'")
    numbers = number_kinds(doubtful.select("word", "shape").distinct(), number_contexts(values)).select(F.col("word").alias("w"), F.col("shape").alias("h"), "number_kind")
    numbers = doubtful.join(numbers, (F.col("word") == F.col("w")) & (F.col("shape") == F.col("h")), "left").select(*kept, F.coalesce("number_kind", F.lit("number_unknown")).alias("kind"))
    quotes = quote_contexts(values).select(F.col("tail").alias("q"), F.when(F.col("goes_on") > F.col("ends"), "quote_goes_on").otherwise("quote_ends").alias("quote_kind"))
    others = feats.where("kind <> 'number'").join(F.broadcast(quotes), (F.col("kind") == "quote") & (F.col("tail") == F.col("q")), "left")  # one row per sentence sign: at most three
    return others.select(*kept, F.when(F.col("kind") == "quote", F.coalesce("quote_kind", F.lit("quote_ends"))).otherwise(F.col("kind")).alias("kind")).unionByName(numbers)


def cells(values: DataFrame) -> DataFrame:
    """Numbers of values by source_id, field_name, len and kind, with what the fit holds on to: characters at risk in the piece, of
    texts of the form (own_exposure) and of all, values at risk at the length, whether the length is a candidate limit. There
    are as many rows as sources, lengths and kinds: the table does not grow with the number of values."""
    counted = values.groupBy("source_id", "field_name", "len", "kind").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumns({"bin": F.floor(F.col("len") / BIN).cast("int"), "is_list": F.col("kind") == "list"})
    of = Window.partitionBy("source_id", "field_name")

    def exposure(*form: str) -> Column:
        longer = F.sum("n").over(Window.partitionBy("source_id", "field_name", *form).orderBy(F.desc("bin")).rangeBetween(Window.unboundedPreceding, -1))
        return F.coalesce(longer, F.lit(0)) * BIN + F.sum(F.col("n") * (F.col("len") % BIN + 1)).over(Window.partitionBy("source_id", "field_name", *form, "bin"))

    at = F.sum("n").over(Window.partitionBy("source_id", "field_name", "len"))
    around = (F.sum("n").over(of.orderBy("len").rangeBetween(-BIN, BIN)) - at) / (2 * BIN)
    return counted.select(
        "*", exposure().alias("exposure"), exposure("is_list").alias("own_exposure"), F.sum("n").over(of.orderBy(F.desc("len")).rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("at_risk"),
        (at > around + 4 * F.sqrt(around) + 5).alias("is_limit"),
    )


def fitted(counted: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """cells with natural and cut (the hazards at the length), ending (log likelihood ratio of the kind) and log_odds."""
    pairs = [F.lit(x) for kv in START.items() for x in kv]
    df = counted.withColumn("p", F.coalesce(F.element_at(F.create_map(*pairs), F.col("kind")), F.lit(0.5)))
    for _ in range(rounds):
        stored = written(df, "fit")
        # of each kind, expected cut and whole values, out of those of its form: as many rows as kinds
        by_kind = stored.groupBy("is_list", "kind").agg(F.sum(F.col("n") * F.col("p")).alias("cut"), F.sum(F.col("n") * (1 - F.col("p"))).alias("whole")).collect()
        ratio = {"": 0.0}
        for r in by_kind:
            start = {x.kind: START.get(x.kind, 0.5) for x in by_kind if x.is_list == r.is_list}
            cut = sum(x.cut + PRIOR * start[x.kind] for x in by_kind if x.kind in start)
            whole = sum(x.whole + PRIOR * (1 - start[x.kind]) for x in by_kind if x.kind in start)
            ratio[r.kind] = math.log((r.cut + PRIOR * start[r.kind]) / cut) - math.log((r.whole + PRIOR * (1 - start[r.kind])) / whole)
        df = stored.repartition("source_id", "field_name")  # one exchange for all three windows
        piece, at = Window.partitionBy("source_id", "field_name", "bin"), Window.partitionBy("source_id", "field_name", "len")
        natural = (F.sum(F.col("n") * (1 - F.col("p"))).over(Window.partitionBy("source_id", "field_name", "is_list", "bin")) + SMOOTH) / F.col("own_exposure")
        spread = (F.sum(F.when(~F.col("is_limit"), F.col("n") * F.col("p")).otherwise(0.0)).over(piece) + SMOOTH) / F.col("exposure")
        spike = (F.sum(F.col("n") * F.col("p")).over(at) + SMOOTH) / F.col("at_risk")
        df = df.select(*counted.columns, natural.alias("natural"), F.when(F.col("is_limit"), F.greatest(spike, spread)).otherwise(spread).alias("cut"), F.element_at(F.create_map(*[F.lit(x) for kv in ratio.items() for x in kv]), F.col("kind")).alias("ending"))
        df = df.withColumn("log_odds", F.log(F.col("cut") / F.col("natural")) + F.col("ending")).withColumn("p", 1 / (1 + F.exp(-F.col("log_odds"))))
    return df


def posteriors(stories: DataFrame) -> DataFrame:
    """Every value with its posterior: id, source_id, field_name, len, kind, is_limit, natural, cut, log_odds (of having been
    cut) and is_case (it was, and stops inside a sentence)."""
    values = written(classed(_with_body(_without_added_lines(_values(stories)))), "classed")
    model = fitted(cells(values)).select(F.col("source_id").alias("s"), F.col("field_name").alias("f"), F.col("len").alias("l"), F.col("kind").alias("k"), "is_limit", "natural", "cut", "log_odds")
    same = F.col("source_id").eqNullSafe(F.col("s")) & (F.col("field_name") == F.col("f")) & (F.col("len") == F.col("l")) & (F.col("kind") == F.col("k"))
    return values.join(model, same).drop("s", "f", "l", "k").withColumn("is_case", (F.col("log_odds") > 0) & (F.col("kind") != "complete"))


def _posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posteriors(table(spark, sf_dir, "story").select("id", "source_id", "summary", "excerpt"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posteriors(spark, sf_dir).where("is_case").select("id", "field_name").distinct()


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts each field, its limits (lengths at which more values are cut than end, with a comma between),
    and the length at which it cuts most."""
    by_len = _posteriors(spark, sf_dir).groupBy("source_id", "field_name", "len").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_case").alias("c"), F.max(F.col("is_limit") & (F.col("cut") > F.col("natural"))).alias("limit"))
    return by_len.groupBy("source_id", "field_name").agg(
        F.sum("n").alias("n_values"), F.sum("c").alias("n_cut"), (F.sum("c") / F.sum("n")).alias("cut_rate"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("limit"), F.col("len")))), ",").alias("limits"),
        F.max_by("len", F.struct("c", -F.col("len"))).alias("commonest_cut_length"), F.max("c").alias("n_at_that_length"),
    )
