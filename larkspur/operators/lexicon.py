"""Lexicon: grammar tags, disambiguation, lemmas and tag transitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from larkspur.functions import text as X
from larkspur.operators import search as S
from larkspur.plans.session import written

#: Grammar tags by number: name, whether it tells a kind of word, whether such words have no meaning of their own, and the pattern of lexicon codes that have it. Fixed values.
TAGS = {
    1: ("Déterminant", True, True, "det"), 2: ("Femenin", False, False, "fem"), 3: ("Masculin", False, False, "mas"), 4: ("Singulier", False, False, "sg"), 5: ("Pluriel", False, False, "pl"),
    6: ("Negatif", True, True, "neg"), 7: ("Negation", False, True, "negadv"), 8: ("Adjetif", True, False, "adj"), 9: ("Verbe", True, False, "^v[^\\s](?!.*adj)"), 10: ("Patronyme", True, False, "^patr\\s"),
    11: ("Prénom", True, False, "^prn\\s"), 12: ("Nom", True, False, "^nom\\s"), 13: ("Adverbe", True, True, "adv"), 14: ("Interjection", True, True, "interj"), 15: ("Préposition", True, True, "prep"),
    16: ("Nombre", True, False, "nb"), 17: ("Conjonction", True, True, "cj"), 18: ("Pronom", True, True, "pro"), 19: ("NomPropre", True, False, "^npr\\s"), 20: ("Sujet", True, True, "propersuj"), 21: ("AuxVerb", True, True, None),
}
ABSTRACT, WORD_TYPES = ([k for k, t in TAGS.items() if t[i]] for i in (2, 1))
NOUN = 12


def grammar_tags(code: Column | str, auxiliary: Column | bool = False) -> Column:
    """Numbers of the tags of a lexicon code, ascending."""
    code = F.col(code) if isinstance(code, str) else code
    auxiliary = F.lit(auxiliary) if isinstance(auxiliary, bool) else auxiliary
    found = [F.when(auxiliary if p is None else code.rlike(p), F.lit(k)) for k, (*_, p) in TAGS.items()]
    return F.array_compact(F.array(*found))


def tag_names(tags: Column | str) -> Column:
    names = F.create_map(*(F.lit(x) for k, t in TAGS.items() for x in (k, t[0])))
    return F.transform(tags, lambda t: names[t])


def _only(tags: Column, kept: list[int]) -> Column:
    return F.filter(tags, lambda t: t.isin(kept))


def disambiguated(entries: Column | str, word: Column | str) -> Column:
    """The entries (array of flexion, lemma, tags, freq) that a word can be.

    If the word has accents and some but not all entries are spelt like it, those. Else if some have a tag without meaning
    of its own, those; of them the ones spelt like the word if these are a thousand times as frequent as the others. Else all.
    """
    entries, word = (F.col(c) if isinstance(c, str) else c for c in (entries, word))
    same = lambda e: F.lower(e["flexion"]) == F.lower(word)
    exact = lambda es: F.filter(es, same)
    rest = lambda es: F.filter(es, lambda e: ~same(e))
    freq = lambda es: F.aggregate(es, F.lit(0.0), lambda s, e: s + e["freq"])
    some = lambda es: F.size(es) > 0
    forced = F.filter(entries, lambda e: F.exists(e["tags"], lambda t: t.isin(ABSTRACT)))
    clear = some(exact(forced)) & some(rest(forced)) & (freq(exact(forced)) > 1000 * freq(rest(forced)))
    return F.when(some(exact(entries)) & some(rest(entries)) & X.contains_accents(word), exact(entries)).when(some(forced) & (F.size(forced) < F.size(entries)), F.when(clear, exact(forced)).otherwise(forced)).otherwise(entries)


def challenged(entries: Column | str, tags: Column) -> Column:
    """The entry whose tags hold all of `tags`, that with the fewest, the first of equals; null if none does."""
    entries = F.col(entries) if isinstance(entries, str) else entries
    fit = F.filter(entries, lambda e: F.size(F.array_except(tags, e["tags"])) == 0)
    order = F.array_sort(F.transform(fit, lambda e, i: F.struct(F.size(e["tags"]).alias("n"), i.alias("i"))))
    return F.when(F.size(fit) > 0, F.get(fit, F.get(order, F.lit(0))["i"]))


def lemmas(df: DataFrame, words: str, lexicon: DataFrame, output: str, simplify: bool = False, stem: bool = False, bonus: float = 0.0) -> DataFrame:
    """df with the lemmas of an array of words.

    lexicon: simplified, flexions, lemmas, tags, forward and backward (arrays with an element for each variant, the last three vectors). Each word is
    looked up by itself; of its variants the one counts whose backward vector is most like the tags chosen for the word before,
    and whose forward vector is most like a variant of the word after (-1 where there is none), with a bonus if it is spelt
    like the word. A word without variants stays, and counts as a noun. Lemmas can be simplified and stemmed after.
    """
    own = ["flexions", "lemmas", "tags", "forward", "backward"]
    looked = S.lookup(df, lexicon, words, "simplified", "simplified", right_select=own, tokenize=None)
    width = NOUN + 1

    def choose(found: list, word_list: list) -> list:
        def like(a: np.ndarray, b: np.ndarray) -> float:
            n = min(len(a), len(b))
            size = np.linalg.norm(a) * np.linalg.norm(b)
            return float(a[:n] @ b[:n] / size) if size else -1.0

        noun = np.eye(width)[NOUN]
        before, out = None, []
        for i, word in enumerate(word_list):
            row = found[i] if i < len(found) else None
            tags = [np.array(t, float) for t in (row["tags"] if row and row["tags"] is not None else [])]
            if not any(len(t) for t in tags):
                before = noun
                out.append(word)
                continue
            after = found[i + 1]["tags"] if i + 1 < len(found) and found[i + 1] and found[i + 1]["tags"] is not None else []
            after = [np.array(t, float) for t in after if t is not None and len(t)]
            scores = []
            for j in range(len(tags)):
                left = -1.0 if before is None else like(before, np.array(row["backward"][j], float))
                right = max((like(t, np.array(row["forward"][j], float)) for t in after), default=-1.0)
                scores.append(left + right + bonus * (row["flexions"][j] == word))
            best = int(np.argmax(scores))
            before = tags[best]
            out.append(row["lemmas"][best])
        return out

    @pandas_udf("array<string>")
    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([None if w is None else choose([] if f is None else list(f), list(w)) for f, w in zip(b["f"], b["w"], strict=True)], dtype=object)

    out = looked.withColumn(output, chosen(F.struct(F.col("array").alias("f"), F.col(words).alias("w")))).drop("array")
    if simplify:
        out = out.withColumn(output, F.transform(output, X.simplify))
    return out.withColumn(output, F.transform(output, X.stem)) if stem else out


def tag_transitions(words: DataFrame) -> DataFrame:
    """(before, after, n, n_before, chance): how often words of the tags `after` follow words of the tags `before`, of words (doc_id, index, tags) that are tagged.

    Only tags that tell a kind of word count. Words follow each other within a document, others between them left out.
    """
    kinds = words.select("doc_id", "index", _only(F.col("tags"), WORD_TYPES).alias("after"))
    w = Window.partitionBy("doc_id").orderBy("index")
    pairs = kinds.withColumn("before", F.lag("after").over(w)).where("before is not null and after is not null")
    counts = pairs.groupBy("before", "after").agg(F.count("*").alias("n"))
    return counts.withColumn("n_before", F.sum("n").over(Window.partitionBy("before"))).withColumn("chance", F.col("n") / F.col("n_before"))


def tag_words(words: DataFrame, lexicon: DataFrame, rounds: int = 2) -> DataFrame:
    """words (doc_id, index, word) with lemma, tags and tag_by: what the lexicon says of a word, and where it says several things what the words beside it ask for.

    lexicon: simplified, entries (array of flexion, lemma, tags, freq). A word with one entry left after disambiguated() is
    tagged `lexicon`. Then, round by round, a word beside a tagged one takes the entry that the likeliest transition from the
    word before asks for (`right`), or else from the word after (`left`). The rest gets its first entry (`any`);
    unknown words stay as they are.
    """
    rows = words.withColumn("_key", X.simplify("word")).join(lexicon.select(F.col("simplified").alias("_key"), "entries"), "_key", "left").drop("_key")
    rows = rows.withColumn("entries", disambiguated("entries", "word"))
    one = F.size("entries") == 1
    rows = rows.withColumn("_e", F.when(one, F.get("entries", F.lit(0)))).withColumn("tag_by", F.when(one, F.lit("lexicon")))
    rows = written(rows)
    w = Window.partitionBy("doc_id").orderBy("index")
    for way, shift, mine, theirs in (("right", F.lag, "after", "before"), ("left", F.lead, "before", "after")) * rounds:
        moves = tag_transitions(rows.where("_e is not null").select("doc_id", "index", F.col("_e.tags").alias("tags")))
        # a row for each set of tags: some tens
        likely = moves.groupBy(theirs).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("chance")).alias("c"), F.col(mine).alias("to")))), lambda x: x["to"]).alias("_to"))
        near = rows.withColumn("_beside", _only(shift("_e").over(w)["tags"], WORD_TYPES))
        met = near.join(F.broadcast(likely.withColumnRenamed(theirs, "_beside")), "_beside", "left")
        tries = F.filter(F.transform("_to", lambda to: challenged("entries", to)), lambda e: e.isNotNull())
        found = F.when(F.col("_e").isNull() & (F.size("entries") > 1), F.get(tries, F.lit(0)))
        rows = written(met.withColumn("tag_by", F.when(F.col("_e").isNull() & found.isNotNull(), way).otherwise(F.col("tag_by"))).withColumn("_e", F.coalesce("_e", found)).drop("_beside", "_to"))
    first = F.get("entries", F.lit(0))
    return rows.select(*words.columns, F.coalesce("_e.lemma", first["lemma"], "word").alias("lemma"), F.coalesce("_e.tags", first["tags"]).alias("tags"), F.coalesce("tag_by", F.when(first.isNotNull(), "any")).alias("tag_by"))


def phrase_numbers(words: DataFrame, size: int = 20) -> DataFrame:
    """words (doc_id, index, word, is_word, tags) with phrase, from 0: a phrase ends at a separator after more than three words, or after `size` words, or, from ten words on, where a subject follows."""
    subject = 20

    def number(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("index")
        phrase, n, after, out = 0, 0, False, []
        for word, is_word, tags in zip(frame["word"], frame["is_word"], frame["tags"], strict=True):
            if is_word and n > 3 and (after or n >= size or n >= 10 and tags is not None and subject in list(tags)):
                phrase, n = phrase + 1, 0
            n += bool(is_word)
            after = bool(set(word or "") & set("\r\n.;!?"))
            out.append(phrase)
        return frame.assign(phrase=out)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema)
    # a document's words are one group
    return words.groupBy("doc_id").applyInPandas(number, f"{kinds}, phrase long")
