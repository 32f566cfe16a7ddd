"""Text functions as Column expressions: all but the two that go through a text sign by sign stay in the JVM."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf

#: Accented letters and the plain ones they are folded to. Fixed values.
ACCENTS = "àáâãäåæèéêëœìíîïðñòóôõöøùúûüç", "aaaaaaaeeeeeiiiioooooooouuuuc"
#: Endings that stem() replaces, the last that fits counts. Fixed values.
STEM_ENDINGS = (
    ("er", ""), ("ereux", ""), ("se", "s"), ("me", "m"), ("ne", "n"), ("aux", ""), ("re", "r"), ("ge", "g"), ("e", ""), ("te", "t"),
    ("ion", ""), ("ce", "c"), ("eu", ""), ("au", ""), ("ement", ""), ("ence", ""), ("innation", "in"), ("atoire", ""), ("gacion", ""), ("itoire", ""),
)
#: A link: scheme, slashes and what may follow. Fixed value.
LINK = r"(?i)(?:https?|ftp|gopher|telnet|file|unsure):(?://|\\)+[\w:#@%/;$()~_?+-=\\.&]*"
#: Characters that begin a phrase wherever they stand, those that do after some words, those that part words, and pronouns that begin one. Fixed values.
HARD_BREAKS, SOFT_BREAKS, WORD_BREAKS, STARTERS = "\n\r\t", ".;:!?", " ()", ("je", "tu", "il", "elle", "vous", "nous", "ils")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold_accents(x: Column | str) -> Column:
    """Small letters without their accents."""
    return F.translate(_c(x), *ACCENTS)


def simplify(x: Column | str) -> Column:
    """Lower case without accents; an l or d before an apostrophe is blanked, hyphens and apostrophes are spaces."""
    return F.translate(F.regexp_replace(fold_accents(F.lower(_c(x))), "[ld](?=')", " "), "-'", "  ")


def simplify_phonetic(x: Column | str) -> Column:
    """Simplified so that letters that sound alike are the same, for street and place names."""
    out = F.lower(_c(x))
    for pattern, by in (("l(?=l)|s(?=s)", ""), ("[ld]'", ""), ("qu?", "c")):
        out = F.regexp_replace(out, pattern, by)
    return fold_accents(F.translate(out, "çzvwkg-", "ssbbcj "))


def contains_accents(x: Column | str) -> Column:
    return F.lower(_c(x)).rlike("[" + ACCENTS[0] + "]")


def contains_phrase_separator(x: Column | str) -> Column:
    return _c(x).rlike(r"[\r\n.;!?]")


def links_as_blanks(x: Column | str) -> Column:
    """Each link becomes as many spaces, so that offsets stay."""
    links = F.regexp_extract_all(_c(x), F.lit(LINK), 0)
    blank = lambda p, i: F.concat(p, F.coalesce(F.repeat(F.lit(" "), F.length(F.get(links, i))), F.lit("")))
    return F.array_join(F.transform(F.split(_c(x), LINK, -1), blank), "")


def tokens(x: Column | str, pattern: str = r"[^\p{L}\p{N}]+", lower: bool = True) -> Column:
    """Non-empty parts between matches of pattern; null for null."""
    x = F.lower(_c(x)) if lower else _c(x)
    return F.filter(F.split(x, pattern), lambda t: t != "")


def without(x: Column | str, stop_words: Iterable[str]) -> Column:
    """Tokens that are no stop word, order and repeats kept."""
    words = list(stop_words)
    return F.filter(_c(x), lambda t: ~t.isin(words)) if words else _c(x)


def ngrams(x: Column | str, n: int) -> Column:
    x = _c(x)
    return F.when(F.size(x) >= n, F.transform(F.sequence(F.lit(1), F.size(x) - n + 1), lambda i: F.slice(x, i, n))).otherwise(F.array().cast("array<array<string>>"))


#: Texts whose runs are Python's objects at once.
TEXTS = 64


def runs_of(texts: pa.Array) -> pa.Array:
    """A list of (word, index, phrase) for each text, null for null, as split_runs() has them; Python's objects are made for TEXTS of them at a time."""
    import regex

    run, ends = regex.compile(r"\p{L}+|[^\p{L}]+"), regex.compile(r"[\r\n.;!?]")
    kind = pa.list_(pa.struct([("word", pa.string()), ("index", pa.int32()), ("phrase", pa.int32())]))
    out = [pa.array([], kind)]
    for at in range(0, len(texts), TEXTS):
        some = texts.slice(at, TEXTS).to_pylist()
        words, index, phrases, begins = [], array("i"), array("i"), array("i", [0])
        for text in some:
            found, phrase = run.findall(text or ""), 0
            for word in found:
                phrases.append(phrase)
                phrase += bool(ends.search(word))
            words += found
            index.extend(range(len(found)))
            begins.append(len(words))
        ints = (pa.Array.from_buffers(pa.int32(), len(x), [None, pa.py_buffer(x)]) for x in (index, phrases))
        rows = pa.StructArray.from_arrays([pa.array(words, pa.string()), *ints], fields=list(kind.value_type))
        begins = pa.Array.from_buffers(pa.int32(), len(begins), [None, pa.py_buffer(begins)])
        out.append(pa.ListArray.from_arrays(begins, rows, type=kind, mask=pa.array([t is None for t in some], pa.bool_())))
    return pa.concat_arrays(out)


def split_runs(x: Column | str, links: bool = False) -> Column:
    """Runs of letters and of other characters, in turn, with index and phrase number: a separator ends a phrase. With links these count as blanks."""
    runs = F.arrow_udf(runs_of, "array<struct<word:string,index:int,phrase:int>>")
    return runs(links_as_blanks(x) if links else _c(x))


def clean_social(x: Column | str, emoticons: Mapping[str, int] = {}, good: str = "great", bad: str = "bad", user: str = "user", link: str = "link") -> Column:  # noqa: B006
    """Links and users become words, retweet marks and hash signs go; emoticons, taken as they stand, become good if their score is above 0, bad below, else nothing. An @ after a letter, digit, hyphen, underscore or dot is no user's."""
    out = F.regexp_replace(_c(x), LINK, f" {link} ")
    for pattern, by in ((r"(?<![a-zA-Z0-9_.-])@\w+\b", f" {user} "), (r"\bRT\b|\bvia\b", " "), ("#", "")):
        out = F.regexp_replace(out, pattern, by)
    for mark, score in emoticons.items():
        out = F.replace(out, F.lit(mark), F.lit(f" {good if score > 0 else bad if score < 0 else ''} "))
    return out


def stem(x: Column | str) -> Column:
    """With the last ending of STEM_ENDINGS that fits replaced, if more than two letters stay before it."""
    x = _c(x)
    fits = [F.when(x.endswith(e) & (F.length(x) - len(e) > 2), F.concat(F.substring(x, F.lit(1), F.length(x) - len(e)), F.lit(by))) for e, by in reversed(STEM_ENDINGS)]
    return F.coalesce(*fits, x)


def normal_tokens(x: Column | str, lower: bool = True, accents: bool = True, most: int | None = None) -> Column:
    """Tokens in lower case, without accents, cut to `most` letters."""
    x = _c(x)
    x = F.transform(x, F.lower) if lower else x
    x = F.transform(x, fold_accents) if accents else x
    return F.transform(x, lambda t: F.substring(t, 1, most)) if most else x


def sentences(x: Column | str, least: int = 3, most: int = 20) -> Column:
    """An array of phrases that together are the text.

    HARD_BREAKS always begin a phrase, SOFT_BREAKS after more than `least` words, WORD_BREAKS after more than `most`, and so
    does a pronoun of STARTERS that a word break follows, after more than `least`. A begin one character after the
    last is none, and a last phrase of fewer than `least` words joins the one before. A null text is one empty phrase.
    """

    def breaks(text: str) -> list[str]:
        begins, last, words, inside = [0], 0, 0, False
        for i, c in enumerate(text):
            was, inside, new = inside, False, False
            if c in HARD_BREAKS:
                new = True
            elif c in SOFT_BREAKS:
                new = words > least
            elif c in WORD_BREAKS:
                new = words > most
            else:
                inside = True
                if not was and any(text[i : i + len(w)].lower() == w and text[i + len(w) : i + len(w) + 1] in tuple(WORD_BREAKS) for w in STARTERS):
                    new = words > least
            if new:
                if last < i - 1:
                    begins.append(i)
                last, words = i, 0
            elif was and not inside:
                words += 1
        if sum(bool(w) for w in re.split(r"[^A-Za-z0-9_]", text[begins[-1] :])) < least and len(begins) > 1:
            begins.pop()
        return [text[b:e] for b, e in zip(begins, [*begins[1:], len(text)], strict=True)]

    @pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [""] if t is None else breaks(t))

    return split(_c(x))


def matching_score(a: Column | str, b: Column | str, cosine: Column | None = None) -> Column:
    """1 for equal tokens, else by one edit for tokens of more than three letters, else the cosine of their vectors, else 0."""
    a, b = F.lower(_c(a)), F.lower(_c(b))
    near = F.levenshtein(a, b, 1)
    rest = F.lit(0.0) if cosine is None else F.coalesce(cosine, F.lit(0.0))
    return F.when(a == b, 1.0).when((F.length(a) > 3) & (near > 0), 1 - near / F.length(a)).otherwise(rest)


def _ratio(x: Column, memory: float) -> Column:
    if memory > 0.5:
        k = 2 * (memory - 0.5)
        return F.least(k + (1 - k) * x, F.lit(1.0))
    low = 1 - 2 * memory
    return F.when(x < low, 0.0).otherwise(F.least((x - low) / max(1 - low, 1e-12), F.lit(1.0)))


def text_similarity(base: Column | str, test: Column | str, memory: float = 1.0, threshold: float = 0.0) -> Column:
    """Weighted mean over the words of base of the best edit similarity with a word of test; later words weigh more with less memory."""
    a, b = (F.filter(F.split(simplify_phonetic(t), r"[^\p{L}0-9]+"), lambda w: w != "") for t in (base, test))
    best = lambda w: F.coalesce(F.array_max(F.transform(b, lambda o: 1 - F.levenshtein(w, o) / F.greatest(F.length(w), F.length(o)))), F.lit(0.0))
    n = F.size(a)
    sims = F.transform(a, lambda w, i: F.struct(best(w).alias("s"), (n * _ratio((i + 1) / n, memory)).alias("w")))
    add = lambda acc, x: F.struct((acc["s"] + F.when(x["s"] < threshold, 0.0).otherwise(x["s"]) * x["w"]).alias("s"), (acc["w"] + x["w"]).alias("w"))
    return F.aggregate(sims, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")), add, lambda acc: F.when(acc["w"] > 0, acc["s"] / acc["w"]).otherwise(0.0))


#: What parts words of an address. Fixed value.
ADDRESS_BREAK = r"[^\p{L}0-9]+"


def address_words(x: Column | str) -> Column:
    return F.filter(F.split(_c(x), ADDRESS_BREAK), lambda w: w != "")


def house_number(x: Column | str) -> Column:
    """The first word with a digit, of nine letters at most, before the comma, or in the first half of the words where there is none; null if there is none."""
    x = _c(x)
    words = address_words(x)
    head = F.when(x.contains(","), address_words(F.substring_index(x, ",", 1))).otherwise(F.slice(words, F.lit(1), (F.size(words) / 2).cast("int")))
    return F.get(F.filter(head, lambda w: w.rlike("[0-9]") & (F.length(w) <= 9)), F.lit(0))


def without_house_number(x: Column | str) -> Column:
    """The address without the first occurrence of its house number."""
    x, n = _c(x), house_number(x)
    at = F.instr(x, n)
    return F.when(n.isNull(), x).otherwise(F.concat(F.substring(x, F.lit(1), at - 1), F.substring(x, at + F.length(n), F.length(x))))


def postcode(x: Column | str) -> Column:
    """The last run of digits, nine of them at most, where any run has four or more; else null."""
    runs = F.regexp_extract_all(_c(x), F.lit(r"([0-9]+)"), 1)
    return F.when(_c(x).rlike("[0-9]{4,}"), F.substring(F.element_at(runs, -1), 1, 9))


def replace_word(x: Column | str, search: Column | str, by: Column | str, last: bool = False) -> Column:
    """x with the first (or last) whole word `search`, one that no letter or digit touches, replaced; x itself if there is none or search is null or empty."""
    x, search, by = _c(x), _c(search), _c(by)
    quoted = F.concat(F.lit("(?<![\\p{L}0-9])\\Q"), search, F.lit("\\E(?![\\p{L}0-9])"))
    parts = F.split(x, quoted, -1)
    n = F.size(parts)
    at = n - 1 if last else F.lit(1)
    join = lambda b, e: F.call_function("array_join", F.slice(parts, b, e), search)
    joined = F.concat(join(F.lit(1), at), by, join(at + 1, n))
    return F.when(F.coalesce(F.length(search) > 0, F.lit(False)) & (n > 1), joined).otherwise(x)


def time_zone_mask(x: Column | str) -> Column:
    return F.array_join(F.transform(F.split(F.regexp_replace(_c(x), "[^A-Za-z]+", ","), ","), lambda t: F.concat(F.lit("tmzz"), t)), ",")


def first_of_list(x: Column | str) -> Column:
    """The part before the first comma."""
    return F.substring_index(_c(x), ",", 1)


def digest(x: Column | str) -> Column:
    """MD5 of text or bytes, hexadecimal."""
    return F.md5(_c(x).cast("binary"))
