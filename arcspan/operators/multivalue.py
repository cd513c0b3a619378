"""Several values packed in one field, one row per value.

A field is a lattice: its nodes are the signs that may delimit, its edges the values between them. Which of them do is
learnt from the whole column by expectation-maximisation: for each two neighbours it is known how often they stand beside
each other and how often each is used at all, so that neighbours which are hardly used apart speak for one value that
holds the sign, and neighbours that are used freely for two. The expected numbers give each sign's rate of joining, and
the frequencies of values less their joined uses, for the next round. Viterbi then picks each field's likeliest path. What
is joined is a value in the next pass, so that values of any number of parts are found. Quoted spans and round brackets
are single edges throughout, and tell of joined values like any other use.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspan.plans.runtime import cut_lineage

#: signs that delimit unless a column speaks against it, and signs that do, with a space on both sides, if a column speaks for it
DELIMITERS = ",;|/\t\n\r"
WEAK = "-–—:·•+&¦"
QUOTES = "\"'"
LISTS = {"[": "]", "{": "}"}
ROUNDS = 3
#: passes after which values of up to 2 to this many parts are found; they end as soon as nothing more is joined
PASSES = 8
#: uses of two neighbours in different fields from which on they may be joined across a sign that delimits
MIN_USES = 3
#: pseudo-counts of joining and splitting of a sign of either sort
PRIOR = {True: (1.0, 200.0), False: (20.0, 1.0)}
#: Beta priors of how often a neighbour follows: bound parts; and free values, around their frequency with this weight
BOUND, FREE = (9.0, 1.0), 5.0


@dataclass(slots=True)
class Piece:
    text: str
    atomic: bool
    start: int
    end: int
    before: str


def _ends_piece(s: str, i: int) -> bool:
    """Whether nothing but spaces comes before the next delimiter or the end."""
    while i < len(s) and s[i] == " ":
        i += 1
    return i == len(s) or s[i] in DELIMITERS


def _closing(s: str, at: int) -> int:
    """Where the quote that opens at a place closes, if a delimiter or the end follows; else -1.

    A lone double quote inside goes on to the next one before a delimiter; a lone single quote is an apostrophe.
    """
    quote, i, lone = s[at], at + 1, False
    while i < len(s):
        if s[i] == quote:
            if not lone and i + 1 < len(s) and s[i + 1] == quote:
                i += 2
                continue
            if _ends_piece(s, i + 1):
                return i
            if quote == "'":
                return -1
            lone = True
        i += 1
    return -1


def _bracket_ends(s: str) -> dict[int, int]:
    """Where each round bracket that is closed at all is closed."""
    opened: list[int] = []
    ends: dict[int, int] = {}
    for i, ch in enumerate(s):
        if ch == "(":
            opened.append(i)
        elif ch == ")" and opened:
            ends[opened.pop()] = i
    return ends


def pieces(field: str) -> tuple[str, list[Piece]]:
    """The field without list brackets, and its non-empty pieces between delimiters outside quotes and round brackets."""
    s = field.strip()
    while len(s) > 1 and s[0] in LISTS and s[-1] == LISTS[s[0]]:
        s = s[1:-1].strip()
    out: list[Piece] = []
    i, start, before, fresh, unclosed = 0, 0, "", True, False
    quoted: tuple[int, int] | None = None
    brackets = _bracket_ends(s) if "(" in s else {}

    def close(end: int, delimiter: str) -> None:
        nonlocal start, before, quoted
        raw = s[start:end]
        if quoted:
            mark = s[quoted[0]]
            text = s[quoted[0] + 1 : quoted[1]].replace(mark * 2, mark).strip()
        else:
            text = raw.strip()
        if text:
            out.append(Piece(text, quoted is not None, start, end, before))
            before = delimiter
        else:
            before = "" if not out else before + delimiter
        start, quoted = end + 1, None

    while i < len(s):
        ch = s[i]
        if ch in DELIMITERS:
            close(i, ch)
            i, fresh = i + 1, True
            continue
        if ch in WEAK and s[i - 1 : i] == " " and s[i + 1 : i + 2] == " " and s[start:i].strip():
            close(i, ch)
            i, fresh = i + 1, True
            continue
        if ch in QUOTES and fresh and quoted is None and not (ch == '"' and unclosed):
            end = _closing(s, i)
            if end > 0:
                quoted, i = (i, end), end
            elif ch == '"':
                unclosed = True  # no later one closes either
        elif ch == "(":
            i = brackets.get(i, i)
        fresh = fresh and ch == " "
        i += 1
    close(len(s), "")
    return s, out


def fold(value: str) -> str:
    return " ".join(value.split()).casefold()


def joints(parts: list[Piece]) -> list[tuple[int, str, str, str]]:
    """(number of the right piece, left key, sign, right key) where two pieces may be one value."""
    return [(j, fold(parts[j - 1].text), parts[j].before, fold(parts[j].text)) for j in range(1, len(parts)) if len(parts[j].before) == 1 and not parts[j].atomic and not parts[j - 1].atomic]


def merged(field: str, joined: list[int] | None) -> list[Piece]:
    """The pieces of a field, those put together that earlier passes joined (numbers of the right pieces)."""
    s, parts = pieces(field)
    if joined is None or not len(joined):
        return parts
    glue, out = set(joined), []
    for k, part in enumerate(parts):
        if k in glue and out:
            last = out[-1]
            out[-1] = Piece(s[last.start : part.end].strip(), False, last.start, part.end, last.before)
        else:
            out.append(part)
    return out


def _log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def log_bound(uses: float, left: float, right: float, total: float) -> float:
    """Log odds, before a sign's own rate, that two neighbours are one value: by the side that is more bound to the other.

    uses: of the two beside each other; left, right: of each at all; total: of all values.
    """

    def side(n: float, other: float) -> float:
        free = min(max((other - uses + 1.0) / (total + 1.0), 1e-12), 0.999)
        bound = _log_beta(uses + BOUND[0], n - uses + BOUND[1]) - _log_beta(*BOUND)
        loose = _log_beta(uses + FREE * free, n - uses + FREE * (1.0 - free)) - _log_beta(FREE * free, FREE * (1.0 - free))
        return bound - loose

    return max(side(left, right), side(right, left))


def _logit(x: float) -> float:
    return math.log(x) - math.log1p(-x)


@dataclass
class Model:
    """What is learnt of the signs (rate of joining); pairs: left, sign, right and log odds of joining, as a table of any length."""

    joining: dict[str, float]
    pairs: DataFrame | None

    def default(self, sign: str) -> float:
        """Log odds of joining of two neighbours that the column tells nothing about."""
        a, b = PRIOR[sign in DELIMITERS]
        return _logit(self.joining.get(sign, a / (a + b)))


def best(parts: list[Piece], odds: dict[int, float], default: Callable[[str], float]) -> list[int]:
    """Viterbi over the lattice of a field: the numbers of the right pieces that are joined to their left neighbours in this pass.

    Edges are single pieces and two joined ones, which weigh as much as their log odds; of equal paths the one with more values.
    """
    n = len(parts)
    able = {j for j, _, _, _ in joints(parts)}
    score, back = [0.0] * (n + 1), [False] * (n + 1)
    for j in range(1, n + 1):
        score[j] = score[j - 1]
        if j - 1 in able:
            w = odds.get(j - 1)
            w = default(parts[j - 1].before) if w is None else w
            if w > 0 and score[j - 2] + w > score[j]:
                score[j], back[j] = score[j - 2] + w, True
    out, j = [], n
    while j > 0:
        if back[j]:
            out.append(j - 1)
        j -= 2 if back[j] else 1
    return out[::-1]


_FIELDS = "v string, joined array<int>"


def learn_model(fields: DataFrame, rounds: int = ROUNDS, min_uses: int = MIN_USES) -> Model:
    """EM over distinct fields (v and joined, see merged), all of them.

    Only the signs' rates come to the driver; values and neighbours stay tables, and nothing depends on their number.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uses: Counter = Counter()
        for b in batches:
            for v, joined in zip(b["v"], b["joined"]):
                parts = merged(v, joined)
                for p in parts:
                    uses[fold(p.text), "", ""] += 1
                    # what is quoted tells of its parts, too
                    if p.atomic and any(d in p.text for d in DELIMITERS):
                        inner = pieces(p.text)[1]
                        uses.update((fold(q.text), "", "") for q in inner)
                        uses.update(x[1:] for x in joints(inner))
                uses.update(x[1:] for x in joints(parts))
            if len(uses) > 200_000:
                yield _frame(uses)
                uses.clear()
        yield _frame(uses)

    summed = fields.mapInPandas(count, "a string, d string, b string, n bigint").groupBy("a", "d", "b").agg(F.sum("n").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    values = summed.where("d = ''").select(F.col("a").alias("k"), F.col("n").alias("n_k"))
    total = values.agg(F.coalesce(F.sum("n_k"), F.lit(0))).first()[0]
    # a sign that may delimit is told by all neighbours, as those used freely elsewhere need not meet twice
    pairs = summed.where((F.col("d") != "") & ((F.col("n") >= min_uses) | ~F.col("d").isin(*DELIMITERS)))
    pairs = pairs.join(values.select(F.col("k").alias("a"), F.col("n_k").alias("n_a")), "a").join(values.select(F.col("k").alias("b"), F.col("n_k").alias("n_b")), "b")
    # of signs that delimit, only neighbours of which one is mostly used beside the other can be joined
    bound = pairs.where((2 * F.col("n") >= F.least("n_a", "n_b")) | ~F.col("d").isin(*DELIMITERS))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["a", "d", "b", "n"]].assign(bound=[log_bound(n, na, nb, total) for n, na, nb in zip(b["n"], b["n_a"], b["n_b"])])

    weighed = bound.mapInPandas(weigh, "a string, d string, b string, n bigint, bound double").persist(StorageLevel.MEMORY_AND_DISK)
    seen = {r["d"]: r["n"] for r in pairs.groupBy("d").agg(F.sum("n").alias("n")).collect()}
    joining = {d: PRIOR[d in DELIMITERS][0] / sum(PRIOR[d in DELIMITERS]) for d in seen}
    logit = lambda: F.coalesce(F.element_at(F.create_map(*[x for d, t in joining.items() for x in (F.lit(d), F.lit(_logit(t)))]), F.col("d")), F.lit(0.0)) if joining else F.lit(0.0)
    for _ in range(rounds if joining else 0):
        expected = {r["d"]: r["n"] for r in weighed.groupBy("d").agg(F.sum(F.col("n") / (1.0 + F.exp(-F.greatest(F.least(logit() + F.col("bound"), F.lit(500.0)), F.lit(-500.0))))).alias("n")).collect()}
        joining = {d: (expected.get(d, 0.0) + PRIOR[d in DELIMITERS][0]) / (n + sum(PRIOR[d in DELIMITERS])) for d, n in seen.items()}
    found = weighed.withColumn("odds", logit() + F.col("bound")).where((F.col("odds") > 0) | ~F.col("d").isin(*DELIMITERS)).select("a", "d", "b", "odds")
    found = cut_lineage(found)
    none = found.isEmpty()
    summed.unpersist()
    weighed.unpersist()
    return Model(joining, None if none else found)


def _frame(uses: Counter) -> pd.DataFrame:
    return pd.DataFrame([(*k, n) for k, n in uses.items()], columns=["a", "d", "b", "n"])


def join_once(fields: DataFrame, model: Model) -> DataFrame:
    """The fields, each with what this pass joins added to joined."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(v, j, x, d, y) for v, joined in zip(b["v"], b["joined"]) for j, x, d, y in joints(merged(v, joined))]
            yield pd.DataFrame(out, columns=["v", "j", "a", "d", "b"])

    hits = None
    if model.pairs is not None:
        near = fields.mapInPandas(spread, "v string, j int, a string, d string, b string").join(model.pairs, ["a", "d", "b"])
        hits = near.groupBy("v").agg(F.collect_list(F.struct("j", "odds")).alias("odds"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for v, joined, odds in zip(b["v"], b["joined"], b["odds"]):
                before = [] if joined is None else sorted(joined)
                parts = merged(v, before)
                # numbers of the merged pieces as numbers of the field's own pieces
                own = [k for k in range(len(pieces(v)[1])) if k not in set(before)]
                new = best(parts, {h["j"]: h["odds"] for h in odds} if odds is not None else {}, model.default)
                out.append(sorted([*before, *(own[j] for j in new)]))
            yield pd.DataFrame({"v": b["v"], "joined": out})

    rates = model.joining
    model = Model(rates, None)
    given = fields.join(hits, "v", "left") if hits is not None else fields.withColumn("odds", F.lit(None).cast("array<struct<j:int,odds:double>>"))
    return given.mapInPandas(run, _FIELDS)


def split_values(df: DataFrame, key: str, column: str, rounds: int = ROUNDS, min_uses: int = MIN_USES, passes: int = PASSES) -> DataFrame:
    """key, pos (int, from 1) and item for each value packed in a column.

    Items are trimmed and lose enclosing quotes; doubled quotes become single; case is kept. List brackets around the
    whole field are taken off. Empty values take no position. Null and blank fields give no rows; a null key is kept;
    repeated rows each give their own; an empty table gives no rows; other columns are not read.
    """
    rows = df.where(F.coalesce(F.trim(column) != "", F.lit(False))).select(F.col(key).alias("__key"), F.col(column).alias("v"))
    fields = rows.select("v").distinct().withColumn("joined", F.array().cast("array<int>")).persist(StorageLevel.MEMORY_AND_DISK)
    current, count = fields, 0
    for _ in range(passes):
        model = learn_model(current, rounds, min_uses)
        if model.pairs is None and not _holds(fields, [d for d in WEAK if model.default(d) > 0]):
            break
        current = cut_lineage(join_once(current, model))
        more = current.agg(F.sum(F.size("joined"))).first()[0] or 0
        if more == count:
            break
        count = more
    kind = df.schema[key].dataType.simpleString()
    if count:
        rows = rows.join(current.where(F.size("joined") > 0), "v", "left")
    else:
        rows = rows.withColumn("joined", F.lit(None).cast("array<int>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, pos, items = [], [], []
            for k, v, joined in zip(b["__key"], b["v"], b["joined"]):
                found = [p.text for p in merged(v, joined)]
                keys += [k] * len(found)
                pos += range(1, len(found) + 1)
                items += found
            yield pd.DataFrame({"__key": pd.Series(keys, dtype=b["__key"].dtype), "pos": pd.Series(pos, dtype="int32"), "item": pd.Series(items, dtype="object")})

    return rows.select("__key", "v", "joined").mapInPandas(run, f"__key {kind}, pos int, item string").select(F.col("__key").alias(key), "pos", "item")


def _holds(fields: DataFrame, signs: list[str]) -> bool:
    """Whether any field holds one of the signs between spaces."""
    return bool(signs) and not fields.where(F.col("v").rlike(f" [{''.join(re.escape(x) for x in signs)}] ")).isEmpty()
