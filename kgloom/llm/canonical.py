"""Free-entered values mapped to a reference list (problem 3).

First a multi-pattern automaton over the names of the list, their usual inversions and the
aliases already resolved to an entity finds the mentions embedded in a value; the longest
non-overlapping ones win, and the value means that entity if nothing but forms of address,
dates and the like is left over. The remaining values go to token-set similarity: every word
of value and name must find its partner, equal, with a few letters wrong, shortened
("univ.", "natl", "I.T."), or run together with its neighbour; the fewest wrong letters win.
Values that fit no entity, or two equally well, are reported as NIL.

Candidates come from exact postings of words and names, however many entities share a word;
nothing is capped. The names are sent to the executors after a check of their number; more
than BLOCK names are matched in blocks of entities, each of which returns what it found and
how many entities it fits, and the blocks are then decided like one list. Values are matched
where they stand, with a memo in each Python worker, so a value that a third of all rows
share costs no shuffle and no hot task.

Defined results: null values are no question and give no row; empty ones, fillers and
pronouns give NIL; repeated rows give one row; ties give NIL; an alias of two entities speaks
for neither.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.llm.lookalike import CYRILLIC, GREEK, plain
from kgloom.session import durable, spread

NIL = "NIL"
#: Names in a broadcast block, and values a worker remembers.
BLOCK, MEMO = 250_000, 300_000

#: Words that say nothing of which entity is meant.
STOP = frozenset("of the a an and on for in their to".split())
#: Those that tell names of the same words apart.
SMALL = frozenset("of on for in".split())
ADDRESS = frozenset("dr prof professor sir mr mrs miss ms mx dame lady lord rev capt lt frs jr sr esq mathematician logician phd".split())
FILLERS = frozenset("he she it they him her his hers its them unknown none null nil tbd n/a na ibid somebody someone anybody nobody anonymous - -- ? ?? ???".split())
#: One word in two forms.
STEM = {"computer": "comput", "computing": "comput", "computers": "comput"}
_AFTER = re.compile(
    r"\s*\([^()]*\)|\s*[-–,]\s*(?:main building|(?:north|south|east|west) wing|old site|dept\.? of [^\W\d_]+|department of [^\W\d_]+)|\s+(?:(?:north|south|east|west) wing|main building|old site)$|,?\s+the (?:younger|elder)\b|\s+of [^\W\d_]+'s circle\b|,?\s+(?:frs|jr\.?|sr\.?)$|,\s*(?:mathematician|logician)\b"
)
_INITIAL_A = re.compile(r"\ba\.")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


def fold(text: str) -> str:
    """Lower case, one script where letters only look alike, no accents."""
    text = plain(text)
    if not text.isascii():
        text = "".join([CYRILLIC.get(c) or GREEK.get(c) or c for c in unicodedata.normalize("NFD", text)])
        text = "".join([c for c in text if not "\u0300" <= c <= "\u036f"])
    return text.casefold().replace("’", "'").strip()


def clean(value: str) -> str:
    """The value without what often stands around a name."""
    v = re.sub(r"\s+", " ", fold(value))
    v = re.sub(r"[\s,;:!]+$", "", re.sub(r"^[\s.,;:'\"]+", "", v))
    v = _AFTER.sub("", v)
    return re.sub(r"(?:'s|')?[\s.,;:!]*$", "", v) + ("." if re.search(r"(?:^|\W)\w\.$", v) else "")


def words(text: str) -> list[str]:
    """The words of a cleaned text without stop words."""
    out = []
    found = _WORD.findall(text.replace("-", " "))
    for w in found:
        w = STEM.get(w, w)
        # a lone "a" beside a name, or with a full stop, is an initial
        if w not in STOP or (w == "a" and (len(found) == 2 or found[-1] == "a" or _INITIAL_A.search(text))):
            out.append(w[:-2] if w.endswith("'s") else w)
    return out


def shortens(short: str, word: str) -> bool:
    """Whether `short` is the start of the word, or keeps its first letter and others in order ("natl", "pb")."""
    if word.startswith(short):
        return True
    if short[0] != word[0] or len(short) > 5:
        return False
    at = iter(word)
    return all(c in at for c in short)


def distance(a: str, b: str, most: int) -> int:
    """Edits (with neighbours swapped as one) from a to b; most + 1 if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    i, m, n = 0, len(a), len(b)  # a common start and end cost nothing
    while i < m and i < n and a[i] == b[i]:
        i += 1
    while m > i and n > i and a[m - 1] == b[n - 1]:
        m, n = m - 1, n - 1
    a, b = a[i:m], b[i:n]
    if not a or not b:
        return min(most + 1, len(a) + len(b))
    # a row of the table of edits as bits: where it rises, where it falls
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    top, d = 1 << (len(a) - 1), len(a)
    up, down, same, before = full, 0, 0, 0
    for c in b:
        eq = at.get(c, 0)
        swap = ((~same & eq) << 1) & before
        same = ((((eq & up) + up) ^ up) | eq | down | swap) & full
        rise, fall = down | (full & ~(same | up)), same & up
        d += (1 if rise & top else 0) - (1 if fall & top else 0)
        rise = rise << 1 | 1
        up, down = (fall << 1 | ~(same | rise)) & full, rise & same & full
        before = eq
    return min(d, most + 1)


def allowed(word: str) -> int:
    """Wrong letters that a word of this length may have."""
    return 0 if len(word) < 4 else 1 if len(word) < 14 else 2


class Matcher:
    """Maps values to the entities of one block."""

    def __init__(self, entities: list[tuple[str, str, tuple[str, ...], tuple[str, ...]]]):
        """entities: (id, type, names, patterns of aliases)."""
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        patterns: dict[str, set[int]] = defaultdict(set)
        full: set[str] = set()  # whole names of people, beside which an initial may stand
        self.ids = [e[0] for e in entities]
        self.words: list[tuple[str, ...]] = []
        self.small: list[frozenset[str]] = []  # the stop words of a name
        self.by_word: dict[str, set[int]] = defaultdict(set)  # of names that aren't a person's two
        self.last: dict[str, dict[str, set[int]]] = defaultdict(lambda: defaultdict(set))
        self.initial: dict[tuple[str, str], set[int]] = defaultdict(set)
        self.squeezed: dict[str, set[int]] = defaultdict(set)
        self.exact: dict[str, set[int]] = defaultdict(set)
        every: set[str] = set()
        for k, (_, kind, names, aliases) in enumerate(entities):
            folded = fold(names[0])
            w = tuple(words(folded))
            self.words.append(w)
            self.small.append(frozenset(x for x in _WORD.findall(folded) if x in STOP))
            every.update(w)
            if kind == "PERSON" and len(w) == 2:
                self.last[w[1]][w[0]].add(k)
                self.initial[w[1], w[0][0]].add(k)
            else:
                for x in w:
                    self.by_word[x].add(k)
            for n in {*names}:
                self.exact[fold(n)].add(k)
                ws = words(fold(n))
                patterns[" ".join(ws)].add(k)
                self.squeezed["".join(ws)].add(k)
                if kind == "PERSON" and len(ws) == 2:
                    a, b = ws
                    for p in (f"{a} {b}", f"{b} {a}", f"{a[0]} {b}", f"{b} {a[0]}"):
                        patterns[p].add(k)
                        full.add(p)
                    self.squeezed[b + a].add(k)
        own = set(patterns)
        for k, e in enumerate(entities):
            for p in {*e[3]}:
                if len(p) > 1 and p not in own:  # what a name itself says isn't for an alias to change
                    patterns[p].add(k)
                    if e[1] == "PERSON" and " " in p:
                        full.add(p)
        for p, ks in patterns.items():
            if p:
                self.automaton.add_word(f" {p} ", (len(p), ks, p not in full))
        self.automaton.make_automaton()
        # three-letter index of words, for those with wrong letters
        self.every = every
        self.grams: dict[str, list[str]] = defaultdict(list)
        for x in every:
            for g in {f"^{x}$"[i : i + 3] for i in range(len(x))}:
                self.grams[g].append(x)
        # words by what is left of them without one letter: words one edit apart share such a rest
        self.rests: dict[str, list[str]] = defaultdict(list)
        for x in every:
            for r in {x, *(x[:i] + x[i + 1 :] for i in range(len(x)))}:
                self.rests[r].append(x)
        self.sorted = sorted(self.by_word)  # for shortened words
        self.squeeze_grams: dict[str, list[str]] = defaultdict(list)
        for x in self.squeezed:
            for g in {x[i : i + 4] for i in range(len(x) - 3)}:
                self.squeeze_grams[g].append(x)
        self.near_memo: dict[str, dict[str, int]] = {}
        self.short_memo: dict[str, frozenset[str]] = {}
        self.memo: dict[str, str] = {}
        self.parts_memo: dict[str, tuple] = {}

    def near(self, word: str) -> dict[str, int]:
        """Words of the list close to this one, with their distance."""
        got = self.near_memo.get(word)
        if got is None:
            got = {word: 0} if word in self.every else {}
            most = allowed(word)
            if most == 1:
                close = {x for r in {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} for x in self.rests.get(r, ())}
            elif most:
                votes: dict[str, int] = defaultdict(int)
                for g in {f"^{word}$"[i : i + 3] for i in range(len(word))}:
                    for x in self.grams.get(g, ()):
                        votes[x] += 1
                # an edit spoils three grams at most, a swap four
                close = {x for x, n in votes.items() if n >= len(word) - 4 * most}
            else:
                close = set()
            for x in close:
                if x not in got and (d := distance(word, x, most)) <= min(most, allowed(x)):
                    got[x] = d
            if len(self.near_memo) < MEMO:
                self.near_memo[word] = got
        return got

    def shortened(self, word: str) -> frozenset[str]:
        """Longer words of the list that this one may stand for."""
        got = self.short_memo.get(word)
        if got is None:
            bare = word.replace("'", "")
            a, b = bisect.bisect_left(self.sorted, bare[:1]), bisect.bisect_left(self.sorted, bare[:1] + "\uffff")
            got = frozenset(x for x in self.sorted[a:b] if len(x) > len(bare) and len(x) > 3 and shortens(bare, x)) if bare and len(bare) <= 7 else frozenset()
            if len(self.short_memo) < MEMO:
                self.short_memo[word] = got
        return got

    def meant(self, value: str) -> str:
        """The entity meant, where this block is the whole list."""
        got = self.memo.get(value)
        if got is None:
            ws = words(clean(value))
            got = decide(ws, [self._parts(value)])
            if len(self.memo) < MEMO:
                self.memo[value] = got
        return got

    def parts(self, value: str) -> tuple:
        """What this block finds of a value: (entities of that name, embedded mentions, similar ones and their cost, run-together ones and theirs).

        Of each kind at most two entities are named, as two are a tie already.
        """
        got = self.parts_memo.get(value)
        if got is None:
            got = self._parts(value)
            if len(self.parts_memo) < MEMO:
                self.parts_memo[value] = got
        return got

    def _named(self, ks) -> list[str]:
        return sorted(self.ids[k] for k in ks)[:2]

    def _parts(self, value: str) -> tuple:
        v = clean(value)
        ws = words(v)
        if not ws or v in FILLERS or fold(value) in FILLERS:
            return [], [], None, [], None, []
        exact = self._named(self.exact.get(v.rstrip("."), ()) or self.exact.get(v, ()))
        spans = []
        if not exact and len(self.automaton):
            found = sorted(((n, end - n - 1, ks, alone) for end, (n, ks, alone) in self.automaton.iter(f" {' '.join(ws)} ")), key=lambda x: (-x[0], x[1]))
            spans = [(a, n, self._named(ks), alone) for n, a, ks, alone in found]
        cost, similar = self._similar([w for w in ws if w not in ADDRESS] or ws, SMALL & {*_WORD.findall(v)})
        run, together = (None, []) if similar else self._squeezed(ws)
        return exact, spans, cost, similar, run, together

    def _similar(self, ws: list[str], small: set[str]) -> tuple[int | None, list[str]]:
        """(wrong letters in quarters, entities) of the closest names by token sets."""
        near = [self.near(w) for w in ws]
        best: dict[float, set[int]] = defaultdict(set)
        self._people(ws, near, best)
        self._others(ws, near, small, best)
        if not best:
            return None, []
        least = min(best)
        return int(4 * least), self._named(best[least])

    def _people(self, ws: list[str], near: list[dict[str, int]], best: dict[float, set[int]]) -> None:
        """People whose last name is one of the words, and whose first name or initial fits the rest."""
        long = [i for i, w in enumerate(ws) if len(w) > 1]
        if not long or len(long) > 2:
            return
        for at in long:
            names = [i for i in long if i != at]
            for last, cost in near[at].items():
                firsts = self.last.get(last)
                if not firsts:
                    continue
                if names and near[names[0]].get(last, 99) < cost:
                    continue  # the other word is closer to this last name
                if names:
                    w = ws[names[0]]
                    for x, d in near[names[0]].items():
                        if x in firsts:
                            best[cost + d] |= firsts[x]
                    if len(w) >= 3:  # short first names with a letter wrong
                        for x, ks in firsts.items():
                            if x not in near[names[0]] and distance(w, x, 1) <= 1:
                                best[cost + 1] |= ks
                    continue
                initials = [w for i, w in enumerate(ws) if i != at]
                if not initials:
                    if cost <= 2:
                        for ks in firsts.values():
                            best[cost + 0.5] |= ks
                    continue
                for c in dict.fromkeys((initials[0], initials[-1])):
                    ks = self.initial.get((last, c))
                    if ks:
                        best[float(cost)] |= ks

    def _others(self, ws: list[str], near: list[dict[str, int]], small: set[str], best: dict[float, set[int]]) -> None:
        """Names all of whose words find a partner, and no word of the value is left."""
        lists = []
        for w, n in zip(ws, near):
            if len(w) == 1:
                continue  # the first letter of any word of a name
            sets = [self.by_word[x] for x in n if x in self.by_word]
            sets += [self.by_word[x] for x in self.shortened(w) if x not in n]
            if not sets:
                return
            lists.append(sets)
        if not lists:
            return
        lists.sort(key=lambda sets: sum(map(len, sets)))
        for k in set().union(*lists[0]):
            if all(any(k in s for s in sets) for sets in lists[1:]):
                cost = self._set(k, ws, near)
                if cost is not None:
                    # between equals, the name with the value's own small words
                    best[cost + (0 if small <= self.small[k] else 0.25)].add(k)

    def _set(self, k: int, ws: list[str], near: list[dict[str, int]]) -> float | None:
        left = list(self.words[k])
        cost, whole = 0.0, 0
        for i in sorted(range(len(ws)), key=lambda i: (min(near[i].values(), default=9), -len(ws[i]))):
            pick = min((x for x in left if x in near[i]), key=lambda x: near[i][x], default=None)
            if pick is not None:
                cost += near[i][pick]
                whole += 1
            else:
                pick = next((x for x in left if len(x) > 3 and shortens(ws[i].replace("'", ""), x)), None)
                if pick is None:
                    if len(ws[i]) == 1 and any(x[0] == ws[i] for x in self.small[k]):
                        continue
                    return None
                cost += 0.25 if pick.startswith(ws[i]) else 1.5
            left.remove(pick)
        # a name of shortened words alone could be anything
        return None if left or cost > 3.75 or not whole else cost

    def _squeezed(self, ws: list[str]) -> tuple[int | None, list[str]]:
        """Words run together or cut apart: the whole value without spaces."""
        s = "".join(ws)
        if len(s) < 8:
            return None, []
        if s in self.squeezed:
            return 0, self._named(self.squeezed[s])
        votes: dict[str, int] = defaultdict(int)
        for g in {s[i : i + 4] for i in range(len(s) - 3)}:
            for x in self.squeeze_grams.get(g, ()):
                votes[x] += 1
        best: dict[int, set[int]] = defaultdict(set)
        most = 2 if len(s) >= 10 else 1
        for x, n in votes.items():
            # an edit spoils four grams at most, a swap five
            if n >= len(s) - 3 - 5 * most and abs(len(x) - len(s)) <= most:
                ks = {k for k in self.squeezed[x] if len(self.words[k]) != len(ws)}  # of as many words it isn't run together
                if ks and (d := distance(s, x, most)) <= most:
                    best[4 * d + 1] |= ks
        return (min(best), self._named(best[min(best)])) if best else (None, [])


def embedded(ws: list[str], spans: list[tuple]) -> set[str]:
    """Entities named by the longest mentions that don't overlap, if nothing but forms of address is left."""
    merged: dict[tuple[int, int], tuple[set[str], bool]] = {}
    for a, n, ids, alone in spans:
        got = merged.get((a, n))
        merged[a, n] = ({*ids, *(got[0] if got else ())}, alone and (got is None or got[1]))
    taken: list[tuple[int, int]] = []
    chosen: list[tuple[set[str], bool]] = []
    for (a, n), what in sorted(merged.items(), key=lambda x: (-x[0][1], x[0][0])):
        if all(a + n <= x or a >= y for x, y in taken):
            taken.append((a, a + n))
            chosen.append(what)
    if len(chosen) != 1:
        return set()
    text = f" {' '.join(ws)} "
    a, b = taken[0]
    rest = (text[:a] + " " + text[b:]).split()
    # an initial may stand between or beside the names of a person
    fits = all(r in ADDRESS or (len(r) == 1 and r.isalpha() and not chosen[0][1]) for r in rest)
    return chosen[0][0] if fits else set()


def decide(ws: list[str], found: list[tuple]) -> str:
    """The entity meant by these words, by what the blocks of the list found; the same for one block and for many."""
    hit = {x for f in found for x in f[0]} or (embedded(ws, [s for f in found for s in f[1]]) if ws else set())
    if len(hit) == 1:
        return hit.pop()
    for cost, ids in ((2, 3), (4, 5)):
        some = [(f[cost], f[ids]) for f in found if f[ids]]
        if some:
            least = min(c for c, _ in some)
            top = {x for c, xs in some if c == least for x in xs}
            return top.pop() if len(top) == 1 else NIL
    return NIL


_MATCHERS: dict[str, Matcher] = {}


def _matcher(shared) -> Matcher:
    """One matcher for each block in a Python worker."""
    if shared.id not in _MATCHERS:
        while len(_MATCHERS) > 1:
            _MATCHERS.pop(next(iter(_MATCHERS)))
        _MATCHERS[shared.id] = Matcher(shared.value)
    return _MATCHERS[shared.id]


class _Shared:
    """A broadcast value that names itself on the executors."""

    def __init__(self, spark, value):
        self.cast = spark.sparkContext.broadcast(value)
        self.id = uuid.uuid4().hex

    @property
    def value(self):
        return self.cast.value


def match_udf(shared: _Shared):
    """value -> entity, where the list is one block."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = _matcher(shared)
        for values in batches:
            yield pd.Series([m.meant(v) for v in values], dtype=object)

    return run


_IDS = T.ArrayType(T.StringType())
_SPAN = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("ids", _IDS), T.StructField("alone", T.BooleanType())])
_PARTS = T.StructType([
    T.StructField("exact", _IDS), T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("cost", T.IntegerType()), T.StructField("similar", _IDS), T.StructField("run", T.IntegerType()), T.StructField("together", _IDS),
])


def parts_udf(shared: _Shared):
    """value -> what one block of several finds."""

    @F.pandas_udf(_PARTS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = _matcher(shared)
        for values in batches:
            rows = [m.parts(v) for v in values]
            spans = [[{"a": a, "n": n, "ids": ids, "alone": alone} for a, n, ids, alone in r[1]] for r in rows]
            yield pd.DataFrame({"exact": [r[0] for r in rows], "spans": spans, "cost": pd.array([r[2] for r in rows], dtype="Int32"), "similar": [r[3] for r in rows], "run": pd.array([r[4] for r in rows], dtype="Int32"), "together": [r[5] for r in rows]})

    return run


@F.pandas_udf(T.StringType())
def _decided(value: pd.Series, found: pd.Series) -> pd.Series:
    def plain_parts(p) -> tuple:
        spans = [(s["a"], s["n"], list(s["ids"]), s["alone"]) for s in p["spans"]]
        return list(p["exact"]), spans, p["cost"], list(p["similar"]), p["run"], list(p["together"])

    return pd.Series([decide(words(clean(v)), [plain_parts(p) for p in f]) for v, f in zip(value, found)], dtype=object)


@F.pandas_udf(T.StringType())
def alias_pattern(aliases: pd.Series) -> pd.Series:
    """The words of an alias as the automaton reads them."""
    return pd.Series([" ".join(words(clean(a))) for a in aliases], dtype=object)


def list_names(entities: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(entity_id, entity_type, names, patterns of aliases) of the reference list; aliases: rows (entity_id, alias), null ids are left out."""
    names = entities.filter(F.col("canonical_name").isNotNull()).select("entity_id", "entity_type", F.array_distinct(F.array_compact(F.array("canonical_name", "label_en", "label_zh"))).alias("names")).dropDuplicates(["entity_id"])
    if aliases is None:
        return names.withColumn("aliases", F.array().cast("array<string>"))
    known = aliases.filter(F.col("entity_id").isNotNull() & F.col("alias").isNotNull()).select("entity_id", "alias").distinct()
    known = known.select("entity_id", alias_pattern("alias").alias("alias")).filter("alias <> ''").distinct()
    known = known.groupBy("alias").agg(F.count("*").alias("n"), F.first("entity_id").alias("entity_id")).filter("n = 1")
    # an entity with very many aliases is a few rows of at most 1,000 each
    known = known.groupBy("entity_id", F.pmod(F.xxhash64("alias"), F.lit(64)).alias("part")).agg(F.collect_list("alias").alias("aliases"))
    return names.join(known.select("entity_id", "aliases"), "entity_id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def _block(rows: DataFrame) -> list[tuple]:
    """The entities of one block, at most about BLOCK names."""
    out: dict[str, list] = {}
    for r in rows.collect():
        e = out.setdefault(r.entity_id, [r.entity_type, tuple(r.names), []])
        e[2] += r.aliases
    return [(k, t, n, tuple(sorted(a))) for k, (t, n, a) in sorted(out.items())]


def canonical_values(values: DataFrame, entities: DataFrame, aliases: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(field, row_id, entity_id) of rows (field, row_id, value); entity_id is NIL where none fits."""
    values = spread(values.filter(F.col("value").isNotNull()).select("field", "row_id", "value"))
    spark = values.sparkSession
    names = durable(list_names(entities, aliases))
    n = names.agg(F.coalesce(F.sum(F.size("names") + F.size("aliases")), F.lit(0))).first()[0]
    blocks = max(1, -(-n // block))
    if blocks == 1:
        return values.select("field", "row_id", match_udf(_Shared(spark, _block(names)))("value").alias("entity_id")).distinct()
    found = None
    for i in range(blocks):
        b = names.filter(F.pmod(F.xxhash64("entity_id"), F.lit(blocks)) == i)
        one = values.select("field", "row_id", "value", parts_udf(_Shared(spark, _block(b)))("value").alias("found"))
        found = one if found is None else found.unionByName(one)
    # a list of one entry for each block of the reference list
    each = found.groupBy("field", "row_id", "value").agg(F.collect_list("found").alias("found"))
    return each.select("field", "row_id", _decided("value", "found").alias("entity_id")).distinct()


def open_values(aliases: DataFrame, labeled: DataFrame) -> DataFrame:
    """The free-entered names that nobody resolved, as (field, row_id, value)."""
    parts = [aliases.filter(F.col("entity_id").isNull()).select(F.lit("aliases.normalized_alias").alias("field"), F.col("alias_id").alias("row_id"), F.col("normalized_alias").alias("value"))]
    for side in ("subject", "object"):
        parts.append(labeled.filter(F.col(f"{side}_entity_id").isNull()).select(F.lit(f"distant_labeled.{side}_text").alias("field"), F.col("candidate_id").alias("row_id"), F.col(f"{side}_text").alias("value")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).filter(F.col("value").isNotNull())
