"""Freely typed values mapped to the entries of a reference list.

A symmetric-delete dictionary holds every phrase of the list (labels in all languages, further names that the caller
gives, plurals, spellings without umlauts, shortened first words, and words without their vowels) under each string that is left when up to d letters are taken out. A typed value
is normalised and searched window by window; windows within the edit bound are ranked by weighted Damerau-Levenshtein
distance and by how often an entry's own label is used in the column.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: largest list of which the dictionary is broadcast; beyond it the deletes of list and values meet in a shuffle join
BROADCAST_REFERENCE = 20_000

#: words that stand around a name and are never misspelt names themselves
AROUND = frozenset(
    "a an and area base building centre de du disturbed early feature fill for from iron age late large lower neolithic bronze no not of or part phase poss possible prob probable possibly rev ruined section shaft site small the undated upper with near by cf see notes report".split()
)


def normal(text: str, umlauts: bool = False) -> str:
    """Lower case without accents and apostrophes, other signs as spaces; with umlauts, ä ö ü become ae oe ue."""
    t = text.casefold().replace("ß", "ss")
    if umlauts:
        t = t.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue")
    t = "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch))
    return " ".join(re.sub(r"[^a-z0-9]+", " ", re.sub(r"['’ʻ`]", "", t)).split())


def allowed(length: int) -> int:
    """Most letters that may be wrong in a phrase of so many letters."""
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 14 else 3


#: deletes are taken from so many first letters: two strings within d edits share a delete of d letters of their heads
HEAD = 10


def deletes(s: str, d: int) -> set[str]:
    s = s[:HEAD]
    return {"".join(ch for k, ch in enumerate(s) if k not in gone) for n in range(d + 1) for gone in map(set, combinations(range(len(s)), n))}


VOWELS = frozenset("aeiouy")


def distance(a: str, b: str, most: float) -> float:
    """Weighted Damerau-Levenshtein (adjacent swaps): doubled letters 0.5, swaps 0.7, vowels among themselves 0.9, the first letter 0.3 more."""
    if abs(len(a) - len(b)) > most / 0.5:
        return math.inf
    above2, above = None, [float(j) for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        row = [float(i)]
        for j in range(1, len(b) + 1):
            x, y = a[i - 1], b[j - 1]
            first = 0.3 if i == 1 or j == 1 else 0.0
            out = 0.5 if i > 1 and x == a[i - 2] else 1.0
            into = 0.5 if j > 1 and y == b[j - 2] else 1.0
            change = 0.0 if x == y else (0.9 if x in VOWELS and y in VOWELS else 1.0) + first
            best = min(above[j] + out, row[j - 1] + into, above[j - 1] + change)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                best = min(best, above2[j - 2] + 0.7)
            row.append(best)
        if min(row) > most + 1:
            return math.inf
        above2, above = above, row
    return above[-1]


#: what a form of an entry is: a whole phrase, a shortened one, one of a label of a single word, one that may be misspelt
FULL, SHORT, SINGLE, LOOSE = 1, 2, 4, 8


def forms(phrases: list[str], label: str) -> dict[str, int]:
    """The strings, without spaces, by which an entry is found, each with what it is.

    Whole phrases with plurals; the label with its first word shortened; and words of the label without their vowels.
    """
    out: dict[str, int] = defaultdict(int)
    for phrase in phrases:
        for form in {normal(phrase), normal(phrase, umlauts=True)} - {""}:
            for key in {form.replace(" ", "")} | ({f"{form}s", f"{form}es"} if " " not in form else set()):
                out[key] |= FULL
    head, _, rest = normal(label).partition(" ")
    single = 0 if rest else SINGLE
    for n in range(2 if rest else 3, len(head)):
        out[head[:n] + rest.replace(" ", "")] |= SHORT | single | (LOOSE if rest and n < 6 else 0)
        if rest and n > 3 or not rest:
            out[head[:n]] |= SHORT | single | (LOOSE if n in (5, 6) and len(head) >= 8 else 0)
    bones = "".join(w[0] + re.sub("[aeiou]", "", w[1:]) for w in (head, *rest.split()) if w)
    if len(bones) >= 4:
        out[bones] |= SHORT | single | (LOOSE if len(bones) > 6 else 0)
    doubled = re.sub(r"(.)\1", r"\1", bones)
    if len(doubled) >= 3 and doubled != head:
        out[doubled] |= SHORT | single
    return out


def resolved(owners: list[tuple[int, int, float]]) -> tuple[int, bool] | None:
    """Of the entries (id, what, prior) that one string stands for: the one meant, and whether it may be misspelt; None if that is open."""
    full = [(prior, ref) for ref, what, prior in owners if what & FULL]
    if full:
        return min(full)[1], True
    short = {ref for ref, what, _ in owners if what & SINGLE} or {ref for ref, _, _ in owners}
    if len(short) != 1:
        return None
    ref = next(iter(short))
    return ref, any(r == ref and what & LOOSE for r, what, _ in owners)


class Dictionary:
    """The phrases of one field: string -> (id, whether it may be misspelt). prior: how rarely each entry's own label is used."""

    def __init__(self, phrases: dict[str, tuple[int, bool]], prior: dict[int, float]):
        self.phrases, self.prior = phrases, prior
        self.known: dict[tuple[str, str, str], tuple[float, int] | None] = {}
        self.index: dict[str, list[str]] = defaultdict(list)
        loose = [key for key, (_, misspelt) in phrases.items() if misspelt]
        self.longest = max(map(len, phrases), default=0)
        for key in loose:
            for cut in deletes(key, allowed(len(key))):
                self.index[cut].append(key)

    @classmethod
    def of(cls, entries: list[tuple[int, list[str], str]], weight: dict[int, int]) -> "Dictionary":
        """entries: (id, phrases, label)."""
        prior = priors(weight, [ref for ref, _, _ in entries])
        owners: dict[str, list] = defaultdict(list)
        for ref, phrases, label in entries:
            for key, what in forms(phrases, label).items():
                owners[key].append((ref, what, prior[ref]))
        return cls({key: found for key, o in owners.items() if (found := resolved(o))}, prior)

    def near(self, s: str, start: str = "", end: str = "") -> tuple[float, int] | None:
        """(cost, id) of the best phrase within the bound; of equal costs the more used entry, then the smaller id.

        Words that are known to stand around names are not misspelt: start and end must be the phrase's own.
        """
        if (s, start, end) not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[s, start, end] = self._near(s, start, end)
        return self.known[s, start, end]

    def _near(self, s: str, start: str, end: str) -> tuple[float, int] | None:
        d = allowed(len(s) + 1)
        best = None
        if len(s) > self.longest + d:
            return None
        for key in {k for cut in deletes(s, d) for k in self.index.get(cut, ())}:
            if abs(len(key) - len(s)) > allowed(len(key)) or not (key.startswith(start) and key.endswith(end)):
                continue
            bound = min(float(allowed(len(key))), 0.29 * len(key))
            cost = distance(s, key, bound)
            if cost <= bound:
                ref = self.phrases[key][0]
                found = (cost + 0.05 * self.prior[ref], cost, ref)
                best = found if best is None or found < best else best
        return None if best is None else (best[1], best[2])

    def find(self, value: str) -> int:
        """The id of the entry that a value names first, 0 if it names none.

        Windows of as many words as a phrase can have are tried from each start. At one start an exact phrase goes before a misspelt
        one, unless that covers more words at a cost of at most 0.17 a letter.
        """
        for words in (normal(value).split(), normal(value, umlauts=True).split()):
            if found := self._find(words):
                return found
        return 0

    def windows(self, words: list[str]) -> Iterator[tuple[list[str], str]]:
        """Windows of words and their letters, from each start the longest first, none longer than any phrase can be."""
        for start in range(len(words)):
            found, s = [], ""
            for end in range(start, len(words)):
                s += words[end]
                if len(s) > self.longest + 3:
                    break
                found.append((words[start : end + 1], s))
            yield found[::-1]

    def _find(self, words: list[str]) -> int:
        for start in self.windows(words):
            exact = fuzzy = None
            for window, s in start:
                if known := self.phrases.get(s):
                    exact = (len(window), known[0])
                    break
                if all(w in AROUND for w in window) or window[-1].isdigit() or len(s) < 4:
                    continue
                if found := self.near(s, window[0] if window[0] in AROUND else "", window[-1] if window[-1] in AROUND else ""):
                    cost = found[0] / len(s)
                    if fuzzy is None or cost < fuzzy[0] - 0.06:
                        fuzzy = (cost, len(window), found[1])
            if exact and fuzzy and fuzzy[1] > exact[0] and fuzzy[0] <= 0.17:
                return fuzzy[2]
            if exact:
                return exact[1]
            if fuzzy:
                return fuzzy[2]
        return 0


def priors(weight: dict[int, int], refs: list[int]) -> dict[int, float]:
    total = sum(weight.get(r, 0) for r in refs) + len(refs)
    return {ref: -math.log((weight.get(ref, 0) + 1) / total) for ref in refs}


def _entries(reference: DataFrame, used: DataFrame, names: DataFrame | None, ref_id: str, field: str, label: str, others: list[str]) -> DataFrame:
    """f, ref, label, phrases and weight (uses of the label itself) of each usable row of the list."""
    rows = reference.where(F.col(ref_id).isNotNull() & F.col(field).isNotNull() & F.col(label).isNotNull()).select(F.col(field).alias("f"), F.col(label).alias("label"), F.col(ref_id).cast("int").alias("ref"), F.array_compact(F.array(label, *others)).alias("phrases"))
    rows = rows.join(used.select("f", F.col("v").alias("label"), F.col("n").alias("weight")), ["f", "label"], "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    if names is None:
        return rows
    more = names.groupBy("label").agg(F.collect_set("name").alias("more"))
    return rows.join(more, "label", "left").select("f", "label", "ref", "weight", F.concat("phrases", F.coalesce("more", F.array().cast("array<string>"))).alias("phrases"))


def dictionaries(entries: DataFrame) -> dict[str, Dictionary] | None:
    """A dictionary for each field, or None for a list that is too long to be broadcast."""
    rows = entries.limit(BROADCAST_REFERENCE + 1).collect()
    if len(rows) > BROADCAST_REFERENCE:
        return None
    rows.sort(key=lambda r: r["ref"])
    out = {}
    for name in {r["f"] for r in rows}:
        mine = [r for r in rows if r["f"] == name]
        out[name] = Dictionary.of([(r["ref"], r["phrases"], r["label"]) for r in mine], {r["ref"]: r["weight"] for r in mine})
    return out


def _phrase_table(entries: DataFrame) -> DataFrame:
    """f, key, ref, loose and prior: the dictionaries of any size as rows."""
    totals = entries.groupBy("f").agg((F.sum("weight") + F.count("*")).alias("total"))
    entries = entries.join(totals, "f").withColumn("prior", -F.log((F.col("weight") + 1) / F.col("total")))

    def all_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(f, key, ref, what, prior) for f, ref, phrases, label, prior in zip(b["f"], b["ref"], b["phrases"], b["label"], b["prior"]) for key, what in forms(list(phrases), label).items()]
            yield pd.DataFrame(out, columns=["f", "key", "ref", "what", "prior"])

    rows = entries.select("f", "ref", "phrases", "label", "prior").mapInPandas(all_forms, "f string, key string, ref int, what int, prior double")
    owner = rows.groupBy("f", "key", "ref").agg(F.expr("bit_or(what)").alias("what"), F.min("prior").alias("prior"))
    single = F.col("what").bitwiseAND(SINGLE) > 0
    full = F.col("what").bitwiseAND(FULL) > 0
    one = owner.groupBy("f", "key").agg(
        F.min(F.when(full, F.struct("prior", "ref"))).alias("full"), F.count_if(single).alias("n_single"), F.count("*").alias("n"), F.min(F.when(single, F.struct("ref", "what", "prior"))).alias("single"), F.min(F.struct("ref", "what", "prior")).alias("any")
    )
    short = F.when(F.col("n_single") == 1, F.col("single")).when((F.col("n_single") == 0) & (F.col("n") == 1), F.col("any"))
    one = one.withColumn("short", short).where(F.col("full").isNotNull() | F.col("short").isNotNull())
    loose = F.col("full").isNotNull() | (F.col("short.what").bitwiseAND(LOOSE) > 0)
    return one.select("f", "key", F.coalesce("full.ref", "short.ref").alias("ref"), loose.alias("loose"), F.coalesce("full.prior", "short.prior").alias("prior"))


def _found_by_shuffle(values: DataFrame, entries: DataFrame) -> DataFrame:
    """f, v and ref of each distinct value, where deletes of the values' windows and of the phrases meet in a join."""
    phrases = _phrase_table(entries).persist(StorageLevel.MEMORY_AND_DISK)
    longest = phrases.agg(F.coalesce(F.max(F.length("key")), F.lit(0))).first()[0]

    def cuts_of_phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cuts = [sorted(deletes(k, allowed(len(k))) | {k}) if loose else [k] for k, loose in zip(b["key"], b["loose"])]
            out = b.loc[b.index.repeat([len(c) for c in cuts])].copy()
            out["cut"] = [c for cut in cuts for c in cut]
            yield out

    def cuts_of_values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ruler = Dictionary({"x" * longest: (0, False)}, {})
        for b in batches:
            out = []
            for f, v in zip(b["f"], b["v"]):
                cuts = {s for words in (normal(v).split(), normal(v, umlauts=True).split()) for start in ruler.windows(words) for _, s in start}
                out += [(f, v, c) for c in set().union(*[deletes(s, allowed(len(s) + 1)) | {s} for s in cuts])] if cuts else []
            yield pd.DataFrame(out, columns=["f", "v", "cut"])

    index = phrases.mapInPandas(cuts_of_phrases, "f string, key string, ref int, loose boolean, prior double, cut string")
    wanted = values.mapInPandas(cuts_of_values, "f string, v string, cut string")
    near = wanted.join(index, ["f", "cut"]).groupBy("f", "v").agg(F.collect_set(F.struct("key", "ref", "loose", "prior")).alias("phrases"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            refs = [Dictionary({p["key"]: (p["ref"], p["loose"]) for p in ps}, {p["ref"]: p["prior"] for p in ps}).find(v) for v, ps in zip(b["v"], b["phrases"])]
            yield b[["f", "v"]].assign(ref_id=pd.Series(refs, index=b.index, dtype="int32"))

    hits = near.mapInPandas(run, "f string, v string, ref_id int")
    return values.join(hits, ["f", "v"], "left").select("f", "v", F.coalesce("ref_id", F.lit(0)).alias("ref_id"))


def map_values(df: DataFrame, key: str, fields: list[str], reference: DataFrame, ref_id: str = "ref_id", field: str = "field_name", label: str = "label", others: tuple[str, ...] = ("label_de", "label_fr"), names: DataFrame | None = None) -> DataFrame:
    """key, field_name, value and ref_id for each non-blank value of the fields that is not itself a label of its field.

    names: label and name, further names of entries. Each distinct value is looked up once. ref_id is 0 for a value that
    means no entry. Null and blank values give no rows; a null key is kept; repeated rows each give their own; very long
    values are searched whole; an empty table gives no rows, an empty reference list only zeros; lists of any length are
    taken (see BROADCAST_REFERENCE); other columns are not read.
    """
    long = df.select(F.col(key).alias("k"), F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in fields])).alias("x")).select("k", "x.f", "x.v").where(F.coalesce(F.trim("v") != "", F.lit(False)))
    used = long.groupBy("f", "v").agg(F.count("*").alias("n"))
    labels = reference.select(F.col(field).alias("f"), F.col(label).alias("v")).where("f is not null and v is not null").distinct()
    entries = _entries(reference, used, names, ref_id, field, label, list(others))
    values = used.select("f", "v").join(labels, ["f", "v"], "left_anti")
    found = dictionaries(entries)
    if found is None:
        mapped = _found_by_shuffle(values, entries)
    else:
        shared = df.sparkSession.sparkContext.broadcast(found)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            dicts = shared.value
            for b in batches:
                refs = [dicts[f].find(v) if f in dicts else 0 for f, v in zip(b["f"], b["v"])]
                yield b.assign(ref_id=pd.Series(refs, index=b.index, dtype="int32"))

        # values cost much more than their bytes tell, so they are spread over all cores whatever their size
        spread = max(df.sparkSession.sparkContext.defaultParallelism, 1) * 2
        mapped = values.repartition(spread, F.xxhash64("f", "v")).mapInPandas(run, "f string, v string, ref_id int")
    cases = long.join(mapped, ["f", "v"])
    return cases.select(F.col("k").alias(key), F.col("f").alias("field_name"), F.col("v").alias("value"), "ref_id")
