"""Splitting oversized items at natural boundaries (problem 9).

A text of more than max_tokens tokens becomes pieces of at most max_tokens, each beginning overlap_tokens before the end of
the one before. Dynamic programming over the boundary positions (ends of paragraphs, sentences, words) picks the cuts:
first as few as possible inside words, then as few as possible at mere word ends, then the least sum of a penalty for
sentence ends against paragraph ends and of the squared differences of the pieces' sizes from equal ones.

Word ends are only needed where two better boundaries lie further apart than a piece can reach, and there only in windows:
the i-th of the fewest possible cuts lies no further right than i greatest steps from the left boundary lead, and no
further left than the greatest steps back from the right one. (Passing over one of the two boundaries saves no cut inside
the gap, as adding it costs none of the worse kind.) Where the word ends alone do not lead across, all of the gap stay,
and places inside words are added in the same way. So leaving positions out changes no best solution.

The texts of a block are worked through together: boundaries and windows over the texts laid end to end, the dynamic
programs of all texts and profiles in lockstep, node by node.

Pieces are spans of the text's own token ids. A piece's text is its tokens' bytes; where the overlap begins inside a
character, that character is given whole. Pieces hold to the limit as spans and encoded by themselves: where a piece that
begins inside a word would take more tokens alone, the text is cut again with a shorter reach, down to pieces of one token
more than the overlap. A piece that takes more even then is marked (over).

Defined results: null texts and texts within the limit give no row; a null or non-positive limit splits nothing; an overlap
not below the limit counts as one less than the limit, a null one and a negative one as 0; a repeated document or profile
gives its pieces as often.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.encode import places
from tidewire.llm.tokenizer import TOKENIZER, TOKENIZER_DIR, encoder, ship_tokenizer, token_bytes
from tidewire.session import table

#: Kinds of cuts and their penalties: a kind outweighs any number of the kinds before it. The last is inside a character.
KINDS = ("paragraph", "sentence", "word", "inside a word", "inside a word")
PENALTY = np.array([0.0, 0.25, 1e5, 1e9, 1e13])
#: Signs of text worked through together, profiles that go to a task together, pairs of positions laid out at once.
BLOCK, PROFILES, WINDOWS = 3_000_000, 64, 500_000

_SENTENCE = re.compile(r"[.!?…。！？।؟][\"'”’»)\]]*(?=\s)")


def _class_table() -> np.ndarray:
    """Per code point: 0 neither, 1 letter or digit, 2 blank, 3 sign that ends a word (apostrophe and hyphen do not)."""
    out = np.ones(0x110000, dtype=np.int8)
    for c in range(128):
        ch = chr(c)
        out[c] = 1 if ch.isalnum() or ch == "_" else 2 if ch.isspace() else 0 if ch in "'-" or c < 32 else 3
    for low, high in ((0x2010, 0x2BFF), (0x3001, 0x303F), (0x1F000, 0x10FFFF), (0xA1, 0xBF)):
        out[low : high + 1] = 3
    out[0x2019] = 0
    for low, high in ((0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[low : high + 1] = 2
    return out


_CLASS = _class_table()


def boundary_kinds(text: str, cp: np.ndarray) -> np.ndarray:
    """Kind (0..3) of a cut before each sign of a text, and at its end."""
    out = np.full(len(cp) + 1, 3, dtype=np.int8)
    cls = _CLASS[cp]
    blank, letter, sign = cls == 2, cls == 1, cls == 3
    out[:-1][blank] = 2
    out[1:-1][sign[1:] & letter[:-1] | letter[1:] & sign[:-1]] = 2
    out[1:][blank] = 2
    out[[m.end() for m in _SENTENCE.finditer(text)]] = 1
    line = np.flatnonzero(cp == 10)
    out[line] = 0
    out[line + 1] = 0
    out[line[1:][np.diff(line) == 1]] = 2  # inside a run of line ends is no end of a paragraph
    return out


class Texts:
    """Encoded texts laid end to end, a zero sign and an end slot after each. A slot is a token or the end of a text.

    first, n: a text's first slot and its tokens; kinds: of a cut before each slot (4: inside a character); char: the sign a
    slot begins in; byte: the slot's first byte; safe: slots before which the tokenizer splits anyway."""

    def __init__(self, texts: list[str], ids: list, name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> None:
        self.joined = "\0".join(texts) + "\0"
        cp = np.frombuffer(self.joined.encode("utf-32-le"), dtype="<u4")
        begins = (np.frombuffer(self.joined.encode(), dtype=np.uint8) & 0xC0) != 0x80
        self.n = np.array([len(x) for x in ids], dtype=np.int64)
        self.first = np.cumsum(self.n + 1) - self.n - 1
        size = np.ones(int((self.n + 1).sum()), dtype=np.int64)
        token = np.ones(len(size), dtype=bool)
        token[self.first + self.n] = False
        size[token] = token_bytes(name, folder)[np.concatenate([np.asarray(x, dtype=np.int64) for x in ids])]
        self.byte = np.cumsum(size) - size
        self.char = (np.cumsum(begins, dtype=np.int64) - 1)[self.byte]
        self.char_byte = np.flatnonzero(begins)
        whole = begins[self.byte]
        self.kinds = np.where(whole, boundary_kinds(self.joined, cp)[self.char], 4).astype(np.int8)
        safe = whole & places(cp)[self.char]
        safe[self.first] = True
        safe[self.first + self.n] = True
        at = np.arange(len(safe))
        self.safe_before = np.maximum.accumulate(np.where(safe, at, 0))
        self.safe_after = np.minimum.accumulate(np.where(safe, at, len(safe))[::-1])[::-1]

    def text(self, begin: int, end: int) -> str:
        return self.joined[self.char[begin] : self.char[end]]


def positions(kinds: np.ndarray, n: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Slots of the cuts that a best solution may need. kinds: the tasks' slots end to end, unusable ones over 4; n: slot of each
    task's end, step: its greatest step. Each task's start and end have kind 0 and are among the slots returned."""
    nodes = np.flatnonzero(kinds <= 1)
    kept = [nodes]
    is_end = np.zeros(len(kinds), dtype=bool)
    is_end[n] = True
    for kind in (2, 3, 4):
        left, right = nodes[:-1], nodes[1:]
        reach = np.repeat(step, np.diff(np.searchsorted(nodes, n, side="right"), prepend=0))[1:]
        far = (right - left > reach) & ~is_end[left]
        if not far.any():
            break
        u, v, reach = left[far], right[far], reach[far]
        nodes = np.flatnonzero(kinds <= kind)
        open_ = np.ones(len(u), dtype=bool)  # gaps that these places lead across
        g, r = np.arange(len(u)), u
        most, least = [], []
        while len(g):
            on = v[g] - r > reach[g]
            g, r = g[on], r[on]
            further = nodes[np.searchsorted(nodes, np.minimum(r + reach[g], v[g] - 1), side="right") - 1]
            on = further > r
            open_[g[~on]] = False
            g, r = g[on], further[on]
            most.append((g, r))
        g = np.flatnonzero(open_)
        r = v[g]
        while len(g):
            on = r - u[g] > reach[g]
            g, r = g[on], r[on]
            r = nodes[np.searchsorted(nodes, np.maximum(r - reach[g], u[g] + 1))]
            least.append(r)
        places = np.flatnonzero(kinds == kind)
        edge = np.zeros(len(places) + 1, dtype=np.int64)
        begin = np.concatenate([*least, u[~open_] + 1])
        end = np.concatenate([*[r[open_[g]] for g, r in most], v[~open_] - 1])
        np.add.at(edge, np.searchsorted(places, begin), 1)
        np.add.at(edge, np.searchsorted(places, end, side="right"), -1)
        kept.append(places[np.cumsum(edge[:-1]) > 0])
    return np.sort(np.concatenate(kept), kind="stable") if len(kept) > 1 else nodes


def best_cuts(kinds: np.ndarray, start: np.ndarray, n: np.ndarray, step: np.ndarray, overlap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the best cuts of each task (its end last), and the task of each; see positions for the parameters. A cut at a
    slot p lets the next lie up to step further on; its piece has so many tokens and the overlap."""
    nodes = positions(kinds, n, step)
    first = np.searchsorted(nodes, start)
    size = np.searchsorted(nodes, n) - first + 1
    task = np.repeat(np.arange(len(n)), size)
    total = n - start
    target = total / np.maximum(2, -(-total // step)) + overlap
    scale = 1 / target
    at = (nodes - start[task]).astype(np.float64)
    scaled = at * scale[task]
    here = (at + (overlap - target)[task]) * scale[task]
    lows = np.maximum(np.searchsorted(nodes, nodes - step[task]), first[task])
    penalty = PENALTY[kinds[nodes]]
    cost, back = np.zeros(len(nodes)), np.full(len(nodes), -1, dtype=np.int64)

    # tasks with most nodes first: those still at work are always the beginning of the list
    order = np.argsort(-size, kind="stable")
    base, left = first[order], size[order]
    active = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1), side="right").tolist()
    done = 1
    while done < len(active):
        steps, nodes_now, windows = [], 0, 0
        while done < len(active) and windows < WINDOWS:  # so many steps at once that what is laid out for them stays small
            j = base[: active[done]] + done
            windows += int((j - lows[j]).sum())
            steps.append(j)
            done += 1
        j = np.concatenate(steps)
        low = lows[j]
        count = j - low
        begins = np.cumsum(count) - count
        index = np.arange(int(count.sum())) + np.repeat(low - begins, count)
        gain = np.repeat(here[j], count) - scaled[index]
        gain *= gain
        least = np.empty(len(j))
        a = c = 0
        for own in steps:
            d = c + len(own)
            b = int(begins[d]) if d < len(j) else len(index)
            best = np.minimum.reduceat(cost[index[a:b]] + gain[a:b], begins[c:d] - a)
            least[c:d] = best
            cost[own] = best + penalty[own]
            a, c = b, d
        hit = np.flatnonzero(cost[index] + gain == np.repeat(least, count))
        which = np.searchsorted(begins, hit, side="right") - 1
        back[j[which[::-1]]] = index[hit[::-1]]  # of equal ones the first
    found, owners = [], []
    now, who = first + size - 1, np.arange(len(n))
    while len(now):
        found.append(now)
        owners.append(who)
        now = back[now]
        on = back[now] >= 0
        now, who = now[on], who[on]
    cuts, owner = np.concatenate(found), np.concatenate(owners)
    by_place = np.argsort(cuts)
    return nodes[cuts[by_place]], owner[by_place]


def split_block(texts: Texts, doc: np.ndarray, limit: np.ndarray, overlap: np.ndarray, enc) -> tuple[np.ndarray, ...]:
    """Pieces of tasks (a text doc under a limit and overlap), in order: task, begin and end slot, kind of the cut, over."""
    reach, todo = limit.copy(), np.arange(len(doc))
    out: list[tuple[np.ndarray, ...]] = []
    while len(todo):
        n, o = texts.n[doc[todo]], overlap[todo]
        # the tasks' slots end to end
        offset = np.cumsum(n + 1) - n - 1
        slot = np.arange(int((n + 1).sum())) + np.repeat(texts.first[doc[todo]] - offset, n + 1)
        kinds = texts.kinds[slot]
        kinds[np.arange(len(slot)) <= np.repeat(offset + o, n + 1)] = 9
        kinds[offset + o] = 0
        kinds[offset + n] = 0
        cuts, who = best_cuts(kinds, offset + o, offset + n, reach[todo] - o, o)
        new = np.r_[True, who[1:] != who[:-1]]
        begin = np.where(new, offset[who], np.r_[0, cuts[:-1]] - o[who])
        last = cuts == (offset + n)[who]
        kind = np.where(last, -1, kinds[cuts])
        begin, end = slot[begin], slot[cuts]
        over = alone(texts, begin, end, limit[todo][who], enc) > limit[todo][who]
        again = np.zeros(len(todo), dtype=bool)
        again[who[over]] = True
        again &= reach[todo] - 1 > o
        final = ~again[who]
        out.append((todo[who[final]], begin[final], end[final], kind[final], over[final]))
        todo = todo[again]
        reach[todo] -= 1
    task, begin, end, kind, over = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((end, task))
    return task[order], begin[order], end[order], kind[order], over[order]


def alone(texts: Texts, begin: np.ndarray, end: np.ndarray, limit: np.ndarray, enc) -> np.ndarray:
    """Tokens of pieces encoded by themselves, or an upper bound of them that is within the limit: only their ends, up to where
    the tokenizer splits anyway, can differ, and no token is shorter than a byte."""
    head, tail = texts.safe_after[begin], texts.safe_before[end]
    none = head > tail
    head, tail = np.where(none, begin, head), np.where(none, begin, tail)
    # the sign a piece begins in is given whole, that it ends in is not
    from_byte, to_byte = texts.char_byte[texts.char[begin]], texts.char_byte[texts.char[end]]
    before, after = np.where(none, 0, texts.byte[head] - from_byte), to_byte - np.where(none, from_byte, texts.byte[tail])
    most = tail - head + before + after
    for i in np.flatnonzero(most > limit).tolist():
        a, b = (texts.joined[texts.char[x[i]] : texts.char[y[i]]] for x, y in ((begin, head), (tail, end)))
        most[i] = tail[i] - head[i] + (len(enc.encode_ordinary(a)) if before[i] else 0) + (len(enc.encode_ordinary(b)) if after[i] else 0)
    return most


def split_documents(docs: DataFrame, profiles: DataFrame, name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """docs (doc_id, text) -> pieces of the oversized ones under each profile (profile, max_tokens, overlap_tokens). The
    profiles go to the tasks in groups of bounded size, however many there are."""
    ship_tokenizer(docs.sparkSession, name, folder)
    columns = {
        "profile": pa.string(), "doc_id": pa.int64(), "piece_no": pa.int32(), "start_token": pa.int32(), "end_token": pa.int32(), "n_tokens": pa.int32(), "cut": pa.string(), "over": pa.bool_(),
        "text": pa.string(),
    }

    def pieces(keys: list, texts: list[str], ids: list, group: list[dict]) -> Iterator[pa.RecordBatch]:
        laid = Texts(texts, ids, name, folder)
        task_profile, task_doc = np.nonzero(np.array([p["max_tokens"] for p in group])[:, None] < laid.n[None, :])
        if not len(task_doc):
            return
        order = np.argsort(task_doc, kind="stable")
        task_profile, task_doc = task_profile[order], task_doc[order]
        limit = np.array([p["max_tokens"] for p in group], dtype=np.int64)[task_profile]
        overlap = np.clip(np.array([p["overlap_tokens"] or 0 for p in group], dtype=np.int64)[task_profile], 0, limit - 1)
        task, begin, end, kind, over = split_block(laid, task_doc, limit, overlap, encoder(name, folder))
        new = np.flatnonzero(np.r_[True, task[1:] != task[:-1]])
        number = np.arange(len(task)) - np.repeat(new, np.diff(np.r_[new, len(task)]))
        origin = laid.first[task_doc[task]]
        names = np.array([*KINDS, "end"], dtype=object)[kind]
        of = [group[i]["profile"] for i in task_profile[task].tolist()]
        made = [of, [keys[i] for i in task_doc[task].tolist()], number, begin - origin, end - origin, end - begin, names, over]
        a, b = laid.char[begin].tolist(), laid.char[end].tolist()
        at = 0
        while at < len(a):  # the texts in batches of bounded size
            to, signs = at, 0
            while to < len(a) and signs < 8_000_000:
                signs += b[to] - a[to]
                to += 1
            parts = [pa.array(c[at:to], t) for c, t in zip(made, columns.values())]
            parts.append(pa.array([laid.joined[x:y] for x, y in zip(a[at:to], b[at:to])], pa.string()))
            yield pa.RecordBatch.from_arrays(parts, names=list(columns))
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for batch in batches:
            numbers = batch.column(2).to_numpy()
            for number in np.unique(numbers).tolist():
                mine = batch.filter(pa.array(numbers == number))
                group = mine.column(3)[0].as_py()
                least = min(p["max_tokens"] for p in group)
                keys, texts, ids, signs = [], [], [], 0
                for key, text in zip(mine.column(0).to_pylist(), mine.column(1)):
                    text = text.as_py()
                    found = enc.encode_ordinary(text) if len(text) * 4 > least else []
                    if len(found) > least:
                        keys.append(key)
                        texts.append(text)
                        ids.append(found)
                        signs += len(text)
                    if signs > BLOCK:
                        yield from pieces(keys, texts, ids, group)
                        keys, texts, ids, signs = [], [], [], 0
                if keys:
                    yield from pieces(keys, texts, ids, group)

    given = profiles.where(F.col("max_tokens") > 0).select(F.struct("profile", F.col("max_tokens").cast("bigint").alias("max_tokens"), F.col("overlap_tokens").cast("bigint").alias("overlap_tokens")).alias("p"))
    many = given.agg(F.ceil(F.count(F.lit(1)) / PROFILES).alias("many"))
    groups = given.crossJoin(many).groupBy(F.pmod(F.xxhash64("p"), "many").alias("number")).agg(F.collect_list("p").alias("group"))  # many: one row
    types = "profile string, doc_id bigint, piece_no int, start_token int, end_token int, n_tokens int, cut string, over boolean, text string"
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("text").isNotNull())
    return rows.crossJoin(groups).mapInArrow(run, types)


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "split_profile"))


def p9_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each profile and kind of cut: pieces, mean and largest size."""
    return p9_pieces(spark, sf_dir).groupBy("profile", "cut").agg(F.count(F.lit(1)).alias("n_pieces"), F.round(F.avg("n_tokens"), 6).alias("mean_tokens"), F.max("n_tokens").alias("most_tokens"))
