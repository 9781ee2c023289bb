"""Text functions as Column expressions (JVM side only)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The named HTML entities a reader decodes, and the stop words of headline matching.
NAMED_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
    "ndash": "\u2013", "mdash": "\u2014", "lsquo": "\u2018", "rsquo": "\u2019", "ldquo": "\u201c", "rdquo": "\u201d", "hellip": "\u2026",
    "eacute": "\u00e9", "egrave": "\u00e8", "agrave": "\u00e0", "ccedil": "\u00e7", "uuml": "\u00fc", "ouml": "\u00f6", "auml": "\u00e4",
    "szlig": "\u00df", "ntilde": "\u00f1", "deg": "\u00b0", "euro": "\u20ac", "pound": "\u00a3", "naira": "\u20a6", "trade": "\u2122",
    "copy": "\u00a9", "reg": "\u00ae", "middot": "\u00b7", "bull": "\u2022", "laquo": "\u00ab", "raquo": "\u00bb",
}
STOPWORDS = (
    "a an the and or but of to in on for with at by from as is are was were be been being it its this that these those has have had will "
    "would can could should may might do does did not no you your we our they their he she his her him them us if than then so up out over "
    "after before into about amid says said say new latest breaking update updates video photos read more"
).split()

ENTITY = r"&(#[xX]?[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]{1,31});"
#: White space beyond what Java's \\s has (fixed values).
OTHER_WS = "\u00a0\u0085\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column | str, body) -> Column:
    """body of x, with x computed once. A plain column is used as it is; anything else is bound as a lambda variable, so that
    nested functions do not multiply the expression."""
    return body(F.col(x)) if isinstance(x, str) else F.element_at(F.transform(F.array(x), body), 1)


def plain_ws(x: Column | str) -> Column:
    """Every Unicode white-space sign as one that Java's \\s knows; texts of one byte a sign are left alone."""
    return let(x, lambda s: F.when(F.length(s) != F.octet_length(s), F.translate(s, OTHER_WS, " " * len(OTHER_WS))).otherwise(s))


def _entity_value(e: Column) -> Column:
    """The character of one entity '&...;'; the entity itself where it names none."""
    body = F.substring(e, 2, 2_000_000)
    body = F.regexp_replace(body, ";$", "")
    digits = F.lower(F.substring(body, 2, 40))
    is_hex = digits.startswith("x")
    hexed = F.when(is_hex, F.substring(digits, 2, 40))
    code = F.when(is_hex & hexed.rlike("^0*[0-9a-f]{1,6}$"), F.conv(hexed, 16, 10)).when(~is_hex & digits.rlike("^0*[0-9]{1,7}$"), digits).cast("int")
    ok = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(ok, code)), 8, "0")), "UTF-32")
    named = F.element_at(F.create_map(*[F.lit(x) for kv in NAMED_ENTITIES.items() for x in kv]), F.lower(body))
    return F.coalesce(F.when(body.startswith("#"), char).otherwise(named), e)


def decode_entities(x: Column | str) -> Column:
    """HTML entities decoded in one pass: what one entity yields is never read again as part of another."""

    def decoded(s: Column) -> Column:
        pieces = F.split(s, ENTITY, -1)
        found = F.regexp_extract_all(s, F.lit(ENTITY), F.lit(0))
        mixed = F.zip_with(pieces, found, lambda p, e: F.concat(p, F.coalesce(_entity_value(e), F.lit(""))))
        return F.when(s.contains("&"), F.array_join(mixed, "")).otherwise(s)

    return let(x, decoded)


def replaced(x: Column | str, where, pattern: str, to: str) -> Column:
    """x with the pattern replaced in texts for which where(text) holds; the others are not searched."""

    def body(t: Column) -> Column:
        return F.when(where(t), F.regexp_replace(t, pattern, to)).otherwise(t)

    return let(x, body)


def html_to_text(x: Column | str) -> Column:
    """Readable text of markup: dropped bodies, block ends as line breaks, tags out, entities decoded, blanks collapsed. Each
    pattern runs only on texts that hold a sign it is for; the others pay for a plain substring search."""

    def tags(s: Column) -> Column:
        out = s
        for name in ("script", "style", "noscript", "iframe", "svg"):
            out = replaced(out, lambda t, n=name: F.lower(t).contains(f"<{n}"), rf"(?is)<{name}(?![A-Za-z0-9_])[^>]*>.*?</{name}\s*>", " ")
        for pattern, to in ((r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), (r"(?s)<!--.*?-->", " ")):
            out = replaced(out, lambda t: t.contains("<!"), pattern, to)
        for pattern, to in ((r"(?i)</(p|div|li|h[1-6]|blockquote|tr)\s*>", "\n"), (r"(?i)<br\s*/?>", "\n"), (r"<[^>]+>", " ")):
            out = F.regexp_replace(out, pattern, to)
        return out

    def ends(s: Column) -> Column:
        # the phrases that feeds end texts with lie within the last 300 signs
        last = F.lower(F.substring(s, -300, 300))
        out = replaced(s, lambda _: last.contains("appeared first on"), r"(?is)(?<![A-Za-z0-9_])The post .{0,160}? appeared first on .{0,80}?\.?\z", " ")
        out = replaced(out, lambda _: last.contains("continue reading"), r"(?is)(?<![A-Za-z0-9_])Continue reading.{0,80}\z", " ")
        return replaced(out, lambda _: last.contains("read more"), r"(?i)(?<![A-Za-z0-9_])Read more(?: here)?[.:]?\s*\z", " ")

    def blanks(s: Column) -> Column:
        out = replaced(F.replace(s, F.lit("\r"), F.lit("")), lambda t: t.contains("  ") | t.contains("\t") | t.contains("\u00a0"), r"[ \t\u00a0]+", " ")
        return replaced(out, lambda t: t.contains("\n"), r"\s*\n\s*", "\n")

    s = let(F.coalesce(c(x), F.lit("")), lambda t: F.when(t.contains("<"), tags(t)).otherwise(t))
    return trim_ws(let(let(decode_entities(s), ends), blanks))


def trim_ws(x: Column | str) -> Column:
    space = rf"[\s{OTHER_WS}]"
    start = lambda s: F.when(F.substring(s, 1, 1).rlike(space), F.regexp_replace(s, f"^{space}+", "")).otherwise(s)
    end = lambda s: F.when(F.substring(s, -1, 1).rlike(space), F.regexp_replace(s, rf"{space}+\z", "")).otherwise(s)
    return let(let(x, start), end)


def single_line(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(plain_ws(html_to_text(x)), r"\s+", " "))


def _fold_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """Accent folding from Unicode decomposition: one-to-one pairs for translate(), the longer ones for replace()."""
    one, to, many = [], [], []
    for cp in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), 0x2122, 0x2026, *range(0xFB00, 0xFB07)]:
        ch = chr(cp)
        folded = "".join(k for k in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(k))
        if folded != ch:
            if len(folded) == 1:
                one.append(ch)
                to.append(folded)
            else:
                many.append((ch, folded))
    return "".join(one), "".join(to), many


FOLD_FROM, FOLD_TO, FOLD_MANY = _fold_tables()


def fold_accents(x: Column | str) -> Column:
    """NFKD without combining marks, for Latin letters and the usual compatibility signs."""
    rest = "".join(k for k, _ in FOLD_MANY)

    def long(s: Column) -> Column:
        out = s
        for k, v in FOLD_MANY:
            out = F.replace(out, F.lit(k), F.lit(v))
        return F.when(s.rlike(f"[{rest}]"), out).otherwise(s)

    plain = let(F.translate(c(x), FOLD_FROM, FOLD_TO), long)
    return F.regexp_replace(plain, r"[\u0300-\u036f]", "")


def tokens(x: Column | str) -> Column:
    """Lower-case ASCII word list of a text, in order, repeats kept."""
    return _words(single_line(x))


def _words(line: Column) -> Column:
    s = F.regexp_replace(fold_accents(F.lower(line)), "['\u2019]", "")
    return F.filter(F.split(s, "[^a-z0-9]+"), lambda t: t != "")


def significant(token_list: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(token_list, lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))


def significant_tokens(x: Column | str) -> Column:
    return significant(tokens(x))


def title_key(x: Column | str) -> Column:
    """32 hex signs that headlines of the same significant words share."""

    def key(line: Column) -> Column:
        sig = F.array_sort(F.array_distinct(significant(_words(line))))
        basis = let(sig, lambda t: F.when(F.size(t) > 0, F.array_join(F.slice(t, 1, 12), " ")).otherwise(F.lower(line)))
        return F.substring(F.sha2(basis, 256), 1, 32)

    return let(single_line(x), key)


#: For each four bits the same bits in lanes of sixteen: four counts are summed in one number.
_LANES = [sum(((n >> k) & 1) << (16 * k) for k in range(4)) for n in range(16)]


def simhash_of_tokens(sig: Column) -> Column:
    """64-bit SimHash of a significant-token list as a BIGINT: unigrams count 1, neighbours joined by '_' count 2. A bit is set if
    more than half the weight has it; the counts of four bits are summed in one number, sixteen numbers in all. Only of lists
    too long for that (their weight would outgrow a lane) every bit is counted by itself."""
    hashed = lambda f: F.conv(F.substring(F.md5(f), 1, 16), 16, -10).cast("bigint")
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    weigh = lambda h, w: F.struct(h.alias("h"), F.lit(w).cast("bigint").alias("w"))
    grams = lambda t: F.transform(F.slice(t, 2, F.greatest(F.size(t), F.lit(1))), lambda x, i: weigh(hashed(F.concat(F.get(t, i), F.lit("_"), x)), 2))
    features = let(F.coalesce(sig, F.array().cast("array<string>")), lambda t: F.concat(F.transform(t, lambda x: weigh(hashed(x), 1)), grams(t)))
    lanes, nibbles = F.array(*[F.lit(x).cast("bigint") for x in _LANES]), F.sequence(F.lit(0), F.lit(60), F.lit(4))
    low = lambda x, shift, mask: F.call_function("shiftrightunsigned", x, shift).bitwiseAND(F.lit(mask).cast("bigint"))

    def summed(fs: Column) -> Column:
        zero = F.array(*[none] * 16)
        counts = F.aggregate(fs, zero, lambda acc, f: F.zip_with(acc, nibbles, lambda n, i: n + F.get(lanes, low(f["h"], i, 15).cast("int")) * f["w"]))
        half = F.aggregate(fs, none, lambda acc, f: acc + f["w"])
        code = lambda cs, total: F.aggregate(
            F.sequence(F.lit(0), F.lit(63)), none,
            lambda acc, i: F.when(2 * low(F.get(cs, (i / 4).cast("int")), (i % 4) * 16, 0xFFFF) > total, acc.bitwiseOR(F.call_function("shiftleft", one, i))).otherwise(acc),
        )
        return let(F.struct(counts.alias("c"), half.alias("t")), lambda m: code(m["c"], m["t"]))

    def voted(fs: Column) -> Column:
        vote = lambda i: F.aggregate(fs, none, lambda acc, f: acc + F.when(F.getbit(f["h"], i) == 1, f["w"]).otherwise(-f["w"]))
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), none, lambda acc, i: F.when(vote(i) > 0, acc.bitwiseOR(F.call_function("shiftleft", one, i))).otherwise(acc))

    return let(features, lambda fs: F.when(F.size(fs) < 30_000, summed(fs)).otherwise(voted(fs)))


def simhash_hex(x: Column | str) -> Column:
    return let(significant_tokens(x), lambda sig: F.lower(F.lpad(F.hex(simhash_of_tokens(sig)), 16, "0")))


def hex_code(x: Column | str) -> Column:
    """A hex text without case and '0x' prefix; null where it is no hex."""
    s = F.regexp_replace(F.lower(trim_ws(x)), "^0x", "")
    return F.when(s.rlike("^[0-9a-f]+$"), s)


def hex_to_long(x: Column) -> Column:
    """BIGINT of up to 16 hex signs (two's complement)."""
    return F.when(F.length(x) <= 16, F.conv(x, 16, -10).cast("bigint"))


def hamming_hex(a: Column, b: Column) -> Column:
    """Bits by which two 16-sign hex codes differ; 64 where one is missing or no such code."""
    x, y = hex_code(a), hex_code(b)
    ok = (F.length(x) == 16) & (F.length(y) == 16)
    return F.when(ok, F.bit_count(hex_to_long(x).bitwiseXOR(hex_to_long(y)))).otherwise(F.lit(64))


#: Words that only say there is no value (fixed values).
NO_VALUE = ["", "-", "--", "?", "n/a", "na", "none", "null", "nil", "nan", "unknown", "undefined", "not available", "not applicable", "no value", "tbd"]


def says_nothing(x: Column | str) -> Column:
    """True for null, blank and for a text that only says there is no value."""
    return F.coalesce(F.lower(F.trim(F.regexp_replace(plain_ws(x), r"\s+", " "))).isin(NO_VALUE), F.lit(True))


def with_line_key(df, line: str, out: str):
    """df with the normal form in which a repeated line is recognised: no tags, entities decoded, lower case, a digit run
    as one sign, white space trimmed and collapsed."""
    from tidewire.session import step

    # each regex runs only on lines that hold a sign it is for; the other lines pay for a plain substring search
    df = step(df, _tw_k1=F.when(c(line).contains("<"), F.regexp_replace(c(line), "<[^<>]*>", "")).otherwise(c(line)))
    df = step(df, _tw_k2=F.lower(decode_entities("_tw_k1")))
    df = step(df, _tw_k3=plain_ws("_tw_k2"))
    k = F.col("_tw_k3")
    df = step(df, _tw_k4=F.when(k.contains("  ") | k.contains("\t") | k.contains("\r") | k.contains("\n") | k.contains("\f") | k.contains("\x0b"), F.regexp_replace(k, r"\s+", " ")).otherwise(k))
    df = step(df, **{out: F.trim(F.regexp_replace("_tw_k4", r"\p{Nd}+", "#"))})
    return df.drop("_tw_k1", "_tw_k2", "_tw_k3", "_tw_k4")
