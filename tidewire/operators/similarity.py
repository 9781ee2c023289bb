"""Duplicates, weighted headline overlap and event clusters.

find_duplicates: rule-ranked matches of new rows against stored ones. cluster_edges: an IDF-weighted set-similarity join
with vetoes inside a time band; candidates come from a lossless prefix filter (of each headline only the rarest words that
any sufficiently similar headline must share), so common words are never joined on. cluster_assign: the edges' components
are independent, and each is replayed in time order.

Defined results: null headlines have no words and no edges; rows without a time are in no band; equal times are ordered by
id; repeated ids are one row for each different content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.text import hex_code, hex_to_long, significant_tokens, title_key
from tidewire.operators.components import components
from tidewire.session import step, table, written

# Thresholds of the cluster rule, hours of the band, and the wording that vetoes a link.
CONTAINMENT, MID_CONTAINMENT, MID_JACCARD, BAND_HOURS = 0.65, 0.45, 0.34, 72
OMNIBUS = (
    r"(?i)(?<![A-Za-z0-9_])(?:round[- ]?up|as it happened|wrap(?:[- ]up)?|recap|highlights|digest|briefing|in pictures|in photos|explainer|what we know|things to know|five things|quiz)(?![A-Za-z0-9_])"
    r"|(?<![A-Za-z0-9_])live(?:blog)?\s*[:|-]|^live(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])live updates?(?![A-Za-z0-9_])"
)
RESULT = r"(?i)(?<![A-Za-z0-9_])(?:beat|beats|beaten|defeat|defeats|defeated|edge|edges|win|wins|won|thrash|thrashes|stun|stuns|victory|triumph|hold|held|draw with|drew)(?![A-Za-z0-9_])"
PREVIEW = r"(?i)(?<![A-Za-z0-9_])(?:host|hosts|to face|face off|preview|clash with|take on|takes on|set to (?:play|face|meet)|vs\.?|versus)(?![A-Za-z0-9_])"
OPINION = r",\s*[Bb][Yy]\s+\p{Lu}[\p{L}'-]+"
NUMBER = r"(?<![A-Za-z0-9_])\d[\d,]*(?![A-Za-z0-9_])"


def is_omnibus(headline: Column | str) -> Column:
    return F.coalesce(F.rlike(headline, F.lit(OMNIBUS)), F.lit(False))


def find_duplicates(incoming: DataFrame, stored: DataFrame, hours: int = BAND_HOURS, bits: int = 4) -> DataFrame:
    """Each incoming row's best match: id, matched_id, rule (1: same URL, 2: same source and title key, 3: same source and
    near simhash). A lower rule pass wins, then the newest stored row, then the smallest id. Rules 2 and 3 hold within the band.
    Rule 3 is blocked by source, time slot and one of bits + 1 equal sub-codes, which no pair within the distance lacks."""
    span = hours * 3_600_000
    shape = lambda df, p: df.select(*[F.col(c).alias(f"{p}{c}") for c in ("id", "source_id", "url_hash", "title_key")], F.unix_millis("fetched_at").alias(f"{p}ms"), hex_to_long(hex_code("simhash")).alias(f"{p}code"))
    a, b = shape(incoming, "a_"), shape(stored, "b_")
    near = F.abs(F.col("a_ms") - F.col("b_ms")) <= span
    out = lambda df, rule, rank: df.select(F.col("a_id").alias("id"), F.col("b_id").alias("matched_id"), F.lit(rule).alias("rule"), F.lit(rank).alias("pass"), F.col("b_ms").alias("ms"))
    by_url = out(a.join(b, F.col("a_url_hash") == F.col("b_url_hash")), 1, 1)
    by_title = out(a.join(b, (F.col("a_source_id") == F.col("b_source_id")) & (F.col("a_title_key") == F.col("b_title_key")) & near), 2, 2)
    parts = bits + 1
    cut = [64 * j // parts for j in range(parts + 1)]
    subs = lambda col: F.posexplode(F.array(*[F.shiftrightunsigned(col, cut[j]).bitwiseAND(F.lit((1 << (cut[j + 1] - cut[j])) - 1).cast("bigint")) for j in range(parts)]))
    slot = lambda p: F.floor(F.col(f"{p}ms") / span)
    left = a.where("a_code is not null").select("*", F.explode(F.array(slot("a_") - 1, slot("a_"), slot("a_") + 1)).alias("t")).select("*", subs("a_code").alias("j", "s"))
    right = b.where("b_code is not null").select("*", slot("b_").alias("u")).select("*", subs("b_code").alias("k", "z"))
    same = (F.col("a_source_id") == F.col("b_source_id")) & (F.col("t") == F.col("u")) & (F.col("j") == F.col("k")) & (F.col("s") == F.col("z"))
    close = F.bit_count(F.col("a_code").bitwiseXOR(F.col("b_code"))) <= bits
    by_code = out(left.join(right, same & near & close), 3, 2).distinct()
    best = F.min_by(F.struct("matched_id", "rule"), F.struct("pass", -F.col("ms"), "matched_id", "rule"))
    return by_url.unionByName(by_title).unionByName(by_code).groupBy("id").agg(best.alias("m")).select("id", "m.matched_id", "m.rule")


def idf_weights(docs: DataFrame, words: str = "words") -> DataFrame:
    """token, df, weight = ln((N + 1) / (df + 1)) + 1 over documents' distinct words."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = docs.select(F.explode(F.array_distinct(words)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n)).select("token", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("weight"))  # one row


def prepared(stories: DataFrame) -> DataFrame:
    """id, ms, title_key, words (distinct, sorted), and what the vetoes need."""
    df = step(stories.select("id", "headline", F.unix_millis("fetched_at").alias("ms"), title_key("headline").alias("title_key")), words=F.array_sort(F.array_distinct(significant_tokens("headline"))))
    result, preview = F.col("headline").rlike(RESULT), F.col("headline").rlike(PREVIEW)
    return df.select(
        "id", "ms", "title_key", "words", is_omnibus("headline").alias("omnibus"), F.coalesce(result & ~preview, F.lit(False)).alias("result_only"),
        F.coalesce(preview & ~result, F.lit(False)).alias("preview_only"), F.coalesce(F.array_distinct(F.regexp_extract_all("headline", F.lit(NUMBER), F.lit(0))), F.array().cast("array<string>")).alias("numbers"),
    )


def weighted(prep: DataFrame, idf: DataFrame) -> DataFrame:
    """prep with total weight and the word list with weights, heaviest first, and prefix: how many of them a match must touch."""
    long = prep.select("id", "title_key", F.explode("words").alias("token")).join(idf.select("token", "weight"), "token")
    bags = long.groupBy("id", "title_key").agg(F.sort_array(F.collect_set(F.struct("weight", "token")), asc=False).alias("bag"))
    df = prep.join(bags, ["id", "title_key"])
    df = step(df, total=F.aggregate(F.array_sort(F.transform("bag", lambda x: F.struct(x["token"], x["weight"]))), F.lit(0.0), lambda s, x: s + x["weight"]))
    # the shortest prefix after which less than the mid containment of the weight remains
    run = F.aggregate(
        "bag", F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
        lambda a, x: F.when(F.col("total") - a["s"] < (MID_CONTAINMENT - 1e-9) * F.col("total"), a).otherwise(F.struct((a["s"] + x["weight"]).alias("s"), (a["n"] + 1).alias("n"))),
    )
    return df.withColumn("prefix", F.transform(F.slice("bag", 1, run["n"]), lambda x: x["token"]))


def cluster_edges(stories: DataFrame, hours: int = BAND_HOURS) -> DataFrame:
    """Scored links: later_id, earlier_id, score, and both times; 1 for equal title keys."""
    headlines = written(prepared(stories), "headlines")
    prep = written(weighted(headlines, idf_weights(headlines)).where("not omnibus").distinct(), "weighted")
    span = hours * 3_600_000
    slot = lambda c: F.floor(F.col(c) / span)
    side = lambda p: prep.select(*[F.col(c).alias(f"{p}_{c}") for c in prep.columns])
    a, b = side("a"), side("b")
    # prefix words of one side meet any words of the other, in their own and the neighbouring time slots
    heads = prep.select(F.col("id").alias("x"), F.col("ms").alias("x_ms"), F.explode("prefix").alias("token")).select("x", "x_ms", "token", F.explode(F.array(slot("x_ms") - 1, slot("x_ms"), slot("x_ms") + 1)).alias("t"))
    alls = prep.select(F.col("id").alias("y"), F.col("ms").alias("y_ms"), slot("ms").alias("u"), F.explode("words").alias("token2"))
    near = F.abs(F.col("x_ms") - F.col("y_ms")) <= span
    by_word = heads.join(alls, (F.col("token") == F.col("token2")) & (F.col("t") == F.col("u")) & near & (F.col("x") != F.col("y"))).select("x", "y")
    # a repeated headline meets itself in its own and the neighbouring slots only
    keys = prep.select(F.col("id").alias("x"), F.col("ms").alias("x_ms"), "title_key", F.explode(F.array(slot("ms") - 1, slot("ms"), slot("ms") + 1)).alias("t"))
    others = prep.select(F.col("id").alias("y"), F.col("ms").alias("y_ms"), F.col("title_key").alias("k"), slot("ms").alias("u"))
    by_key = keys.join(others, (F.col("title_key") == F.col("k")) & (F.col("t") == F.col("u")) & near & (F.col("x") < F.col("y"))).select("x", "y")
    pairs = by_word.unionByName(by_key).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    both = pairs.join(a, F.col("x") == F.col("a_id")).join(b, F.col("y") == F.col("b_id"))
    stage = (F.col("a_result_only") & F.col("b_preview_only")) | (F.col("b_result_only") & F.col("a_preview_only"))
    figures = (F.size("a_numbers") > 0) & (F.size("b_numbers") > 0) & ~F.arrays_overlap("a_numbers", "b_numbers")
    other_words = F.col("b_words")
    shared = F.aggregate(F.array_sort(F.transform(F.filter("a_bag", lambda x: F.array_contains(other_words, x["token"])), lambda x: F.struct(x["token"], x["weight"]))), F.lit(0.0), lambda s, x: s + x["weight"])
    scored = step(both.where(~stage), _shared=shared)
    scored = step(scored, _c=F.round(F.try_divide("_shared", F.least("a_total", "b_total")), 12), _j=F.round(F.try_divide(F.col("_shared"), F.col("a_total") + F.col("b_total") - F.col("_shared")), 12))
    score = (
        F.when(F.col("a_title_key") == F.col("b_title_key"), F.lit(1.0)).when(F.col("_c") >= CONTAINMENT, F.col("_c"))
        .when((F.col("_c") >= MID_CONTAINMENT) & (F.col("_j") >= MID_JACCARD) & ~figures, (F.col("_c") + F.col("_j")) / 2)
    )
    a_first = F.struct("a_ms", "a_id") < F.struct("b_ms", "b_id")
    pick = lambda x, y: F.when(a_first, F.col(y)).otherwise(F.col(x))
    found = scored.select(pick("a_id", "b_id").alias("later_id"), pick("b_id", "a_id").alias("earlier_id"), score.alias("score"), pick("a_ms", "b_ms").alias("later_ms"), pick("b_ms", "a_ms").alias("earlier_ms"))
    return found.where("score is not null").groupBy("later_id", "earlier_id").agg(F.max("score").alias("score"), F.max("later_ms").alias("later_ms"), F.max("earlier_ms").alias("earlier_ms"))


def replay(ids: list, times: list, edges: dict, hours: int = BAND_HOURS) -> dict:
    """Clusters of one component, row by row in order of (time, id): a row joins the cluster of its best earlier match whose
    lead (the cluster's earliest row within the band) it matches too; otherwise it opens one, named by its id."""
    span = hours * 3_600_000
    order = sorted(range(len(ids)), key=lambda i: (times[i], ids[i]))
    cluster: dict = {}
    members: dict = {}
    at = dict(zip(ids, times))
    for i in order:
        me, best = ids[i], None
        for other, score in edges.get(me, {}).items():
            if other not in cluster or at[me] - at[other] > span:
                continue
            lead = next(m for m in members[cluster[other]] if at[me] - at[m] <= span)
            if lead != other and lead not in edges[me]:
                continue
            rank = (score, at[other], other)
            if best is None or rank > best:
                best = rank
        cluster[me] = cluster[best[2]] if best else me
        members.setdefault(cluster[me], []).append(me)
    return cluster


def cluster_assign(stories: DataFrame, hours: int = BAND_HOURS) -> DataFrame:
    """id, cluster (id of the row that opened it). Rows without links are clusters of their own."""
    import pandas as pd

    edges = written(cluster_edges(stories, hours), "cluster-edges")
    labelled = edges.join(components(edges, "later_id", "earlier_id"), F.col("later_id") == F.col("node")).select("label", "later_id", "earlier_id", "score", "later_ms", "earlier_ms")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = dict(zip(pdf.earlier_id, pdf.earlier_ms)) | dict(zip(pdf.later_id, pdf.later_ms))
        links: dict = {}
        for x, y, s in zip(pdf.later_id, pdf.earlier_id, pdf.score):
            links.setdefault(x, {})[y] = s
        found = replay(list(at), list(at.values()), links, hours)
        return pd.DataFrame({"id": list(found), "cluster": list(found.values())})

    linked = labelled.groupBy("label").applyInPandas(run, "id string, cluster string")
    return stories.select("id").distinct().join(linked, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def rates(m: DataFrame) -> DataFrame:
    """m (tp, fp, fn) with precision (1 where nothing is found), recall and F1."""
    p, r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(1.0)), F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return m.withColumns({"precision": F.round(p, 9), "recall": F.round(r, 9), "f1": F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 9)})


def evaluation(stories: DataFrame, hours: int = BAND_HOURS) -> DataFrame:
    """The cluster rule's scores against stored clusters (cluster_id), over all pairs of different ids: threshold, tp, fp, fn,
    tn, precision, recall, f1. Found are the cluster_edges of at least the threshold; pairs they leave out (vetoed, outside
    the band, too unlike) are only counted, from the sizes of the clusters and of the table. A repeated id has its smallest
    cluster_id; rows without one are in no cluster."""
    of = written(stories.where("id is not null").groupBy("id").agg(F.min("cluster_id").alias("c")), "clusters")
    pairs = lambda: F.expr("cast(n * (n - 1) div 2 as bigint)")
    sizes = of.where("c is not null").groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    together = sizes.agg(F.coalesce(F.sum(pairs()), F.lit(0)).alias("together"))
    every = together.join(F.broadcast(of.agg(F.count(F.lit(1)).alias("n")).select(pairs().alias("every"))))  # one row each
    clusters = lambda i, c: of.select(F.col("id").alias(i), F.col("c").alias(c))
    edges = cluster_edges(stories.select("id", "headline", "fetched_at"), hours).where("later_id <> earlier_id")
    edges = edges.join(clusters("later_id", "c1"), "later_id").join(clusters("earlier_id", "c2"), "earlier_id")
    at = F.explode(F.array(*[F.lit(t / 10) for t in range(1, 9)])).alias("threshold")
    hits = edges.select("score", F.coalesce(F.col("c1") == F.col("c2"), F.lit(False)).alias("same"), at).where("score >= threshold")
    hits = hits.groupBy("threshold").agg(F.count_if("same").alias("tp"), F.count_if(~F.col("same")).alias("fp"))
    m = every.select("together", "every", at).join(hits, "threshold", "left").fillna(0, ["tp", "fp"])
    return rates(m.select("threshold", "tp", "fp", (F.col("together") - F.col("tp")).alias("fn"), (F.col("every") - F.col("together") - F.col("fp")).alias("tn")))


def _stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "story").select("id", "headline", "fetched_at")


def q_find_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_duplicates(table(spark, sf_dir, "story_batch").withColumns({c: hex_code(c) for c in ("url_hash", "title_key")}), table(spark, sf_dir, "story"))


def q_idf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _stories(spark, sf_dir).select(significant_tokens("headline").alias("words"))
    return idf_weights(docs).withColumn("weight", F.round("weight", 9))


def q_cluster_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_edges(_stories(spark, sf_dir)).select("later_id", "earlier_id", F.round("score", 6).alias("score"))


def q_cluster_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_assign(_stories(spark, sf_dir))


def q_format_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda pattern: F.coalesce(F.col("title").rlike(pattern), F.lit(False))
    return table(spark, sf_dir, "raw_feed_item").select(
        "item_id", is_omnibus("title").alias("omnibus"), flag(RESULT).alias("result"), flag(PREVIEW).alias("preview"), flag(OPINION).alias("opinion"), F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce("title", F.lit("")), F.lit(NUMBER), F.lit(0)))), "|").alias("numbers")
    )


def q_pair_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word overlap of headlines against stored clusters, over pairs of one source and day: true and false positives and
    negatives, precision, recall and F1 at eight thresholds. cluster_evaluation is the one of the cluster rule, over all pairs."""
    s = _stories(spark, sf_dir).join(table(spark, sf_dir, "story").select("id", "cluster_id", "source_id"), "id")
    s = s.select("id", "cluster_id", "source_id", F.floor(F.unix_millis("fetched_at") / 86_400_000).alias("day"), F.array_distinct(significant_tokens("headline")).alias("w"))
    s = written(s, "evaluation")
    b = s.select(F.col("id").alias("id2"), F.col("cluster_id").alias("c2"), F.col("source_id").alias("s2"), F.col("day").alias("d2"), F.col("w").alias("w2"))
    pairs = s.join(b, (F.col("source_id") == F.col("s2")) & (F.col("day") == F.col("d2")) & (F.col("id") < F.col("id2")))
    both = F.size(F.array_intersect("w", "w2"))
    pairs = step(pairs, sim=F.coalesce(F.try_divide(both, F.size(F.array_union("w", "w2"))), F.lit(0.0)), same=F.coalesce(F.col("cluster_id") == F.col("c2"), F.lit(False)))
    # the few levels of similarity are counted first, then summed at each threshold
    levels = pairs.groupBy("sim", "same").agg(F.count(F.lit(1)).alias("n"))
    at = levels.select("*", F.explode(F.array(*[F.lit(t / 10) for t in range(1, 9)])).alias("threshold"))
    hit = F.col("sim") >= F.col("threshold")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    m = at.groupBy("threshold").agg(total(hit & F.col("same")).alias("tp"), total(hit & ~F.col("same")).alias("fp"), total(~hit & F.col("same")).alias("fn"), total(~hit & ~F.col("same")).alias("tn"))
    return rates(m)


def q_cluster_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation(table(spark, sf_dir, "story").select("id", "headline", "fetched_at", "cluster_id"))
