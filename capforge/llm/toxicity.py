"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

1. Character trigrams (a to z without diacritics, and a word boundary) are counted over all texts;
   the table has at most 27^3 rows and is collected.
2. Words with digits, symbols, separators or look-alike letters among letters, words of signs alone, words
   with a letter three times in a row, and runs of single characters are lattices: every position offers its
   letter, the letters its sign or look-alike may stand for, nothing, or a word boundary. Viterbi decoding
   finds the letters that are likeliest under channel costs and trigrams. Every other word has one path,
   itself, and is kept. Neighbouring tokens, however many, are also read as one word where its trigrams cost less than
   those of the parts with boundaries. Kept are also words of other scripts (without punctuation; where a script has no spaces also
   pairs of neighbouring characters). Numbers are left out. Only a to z have a lattice.
3. Features of a text's restored words, with double letters squeezed, are the words, their prefixes of
   4, 5 and 6 letters, and prefixes that begin two or more of its words. At most ``train_rows``
   labelled rows (a hash sample; the bound of the fit) are stored. Every feature that occurs in their
   toxic rows beyond chance (G-test over all features that can pass it) and above the base rate enters an L2-penalised logistic
   regression, which gets a label and a few feature numbers a row. Texts that repeat are one labelled row. Words are learnt from
   tokens and runs of single characters; once a feature is known, every sequence of tokens that may spell it is read.
4. A row's score is the regression's probability. Documents are scored where they are.

Labels are used only of rows whose crc32(doc_id as text) mod 5 isn't 0, and ids, languages, sources
and labels are no features. Whole texts are scored wherever they are; nothing is shuffled by text.

Defined results: null and empty texts get the score of the intercept, as do texts without telling features; a null id
counts as an empty one; rows that repeat get equal scores; no labels or no toxic labels give one
low score to all, no clean ones one high score; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capforge.llm.common import stored, task_memory, text_or_empty

#: Bounds of the classifier's fit.
TRAIN_ROWS = 30_000
PREFIXES = (4, 5, 6)
RIDGE = 0.2
#: Log-odds of every text where the labels name no toxic row (negated: no clean one).
NOTHING = -5.0
#: Restored words that a task remembers at once.
REMEMBERED = 200_000

# Letters that a sign may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
         "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i"}
# Letters drawn with several signs.
DRAWN = {"|_|": "u", "()": "o", "|<": "k", "\\/\\/": "w", "\\/": "v", "/\\": "a", "|\\|": "n"}
# Letters that have no decomposition, and letters of other scripts that look like one of a to z.
UNDECOMPOSED = str.maketrans({"ß": "ss", "ł": "l", "ø": "o", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "ħ": "h",
                              "ŋ": "n", "ŧ": "t", "ĸ": "k", "ƀ": "b", "ɨ": "i", "ʉ": "u", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ə": "e"})
LOOKALIKE = {**dict(zip("авгеёикмнопрстухіјѕԁԛԝһӏьз", "abreeukmhonpctyxijsdqwhlbz")), **dict(zip("αβεηικνοπρτυχωσγ", "abenikvonptuxwoy"))}
# Numbers, and characters of scripts without spaces between words.
NUMBER = re.compile(r"[$€£+]?(?:\d[\d.,:/\-]*)?\d[%$€£+]?")
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
# Channel costs (negative log probabilities).
SUBSTITUTED, SIGN_DROPPED, MARK_DROPPED, BOUNDARY_KEPT, REPEAT_DROPPED = 1.0, 12.0, 0.5, 2.5, 0.5

EDGE = ".,;:?\"'()[]{}<>«»“”„’…*_-~`/\\#%&="
TRIPLE = re.compile(r"(.)\1\1")
DOUBLE = re.compile(r"(.)\1+")


class Folded(dict):
    """What a code point is without diacritics; made when first asked for."""

    def __missing__(self, point: int) -> str:
        made = "".join(c for c in unicodedata.normalize("NFKD", UNDECOMPOSED.get(point, chr(point))) if not unicodedata.combining(c))
        self[point] = made
        return made


FOLDED = Folded()


def fold(text: str) -> str:
    """Lower case without diacritics."""
    text = text.lower()
    return text if text.isascii() else text.translate(FOLDED)


def symbols() -> np.ndarray:
    """0 (boundary) to 26 for every code point below U+0250."""
    to = np.zeros(0x250, np.int64)
    for i in range(0x250):
        c = fold(chr(i))[:1]
        if "a" <= c <= "z":
            to[i] = ord(c) - 96
    return to


def trigram_counts(text: str, symbol: np.ndarray) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = symbol[np.where(points < 0x250, points, 32)]
    s = np.concatenate([[0, 0], s, [0]])
    s = s[np.concatenate([[True, True], (s[2:] != 0) | (s[1:-1] != 0)])]  # a gap is one boundary
    return np.bincount(s[:-2] * 729 + s[1:-1] * 27 + s[2:], minlength=27 ** 3)


def count_trigrams(texts: DataFrame) -> np.ndarray:
    """Trigram counts over all rows of the one text column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, symbol = np.zeros(27 ** 3, np.int64), symbols()
        for batch in batches:
            held, size = [], 0
            for t in batch.column(0).to_pylist():
                held.append(t)
                size += len(t)
                if size > 1_000_000:
                    total += trigram_counts("\n".join(held), symbol)
                    held, size = [], 0
            total += trigram_counts("\n".join(held), symbol)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["gram", "n"])

    out = np.zeros(27 ** 3, np.int64)
    for row in texts.mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[row.gram] = row.n
    return out


def trigram_costs(counts: np.ndarray) -> list[float]:
    n = counts.reshape(729, 27) + 0.5
    return (-np.log(n / n.sum(axis=1, keepdims=True))).ravel().tolist()


def lattice(signs: str) -> list[list[tuple[int, float]]]:
    """For each position its options (symbol, cost); symbol -1: nothing, 0: a boundary."""
    out, last = [], ""
    for c in signs:
        if "a" <= c <= "z":
            options = [(ord(c) - 96, 0.0)]
            if c == last:
                options.append((-1, REPEAT_DROPPED))
        elif c in SIGNS:
            options = [(ord(x) - 96, SUBSTITUTED) for x in SIGNS[c]] + [(-1, REPEAT_DROPPED if c == last else SIGN_DROPPED)]
        elif c in LOOKALIKE:
            options = [(ord(LOOKALIKE[c]) - 96, SUBSTITUTED), (-1, REPEAT_DROPPED if c == last else SIGN_DROPPED)]
        else:
            options = [(-1, MARK_DROPPED), (0, BOUNDARY_KEPT)]
        out.append(options)
        last = c
    return out


def decode(signs: str, costs: list[float]) -> list[str]:
    """The words on the best path through the lattice of ``signs``."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in lattice(signs):
        step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in best.items():
            for symbol, price in options:
                if symbol < 0 or symbol == 0 == b:
                    key, total, way = (a, b), cost + price, path
                else:
                    key, total, way = (b, symbol), cost + price + costs[a * 729 + b * 27 + symbol], (symbol, path)
                if key not in step or total < step[key][0]:
                    step[key] = (total, way)
        best = step
    _, way = min(((cost + (costs[a * 729 + b * 27] if b else 0.0), path) for (a, b), (cost, path) in best.items()),
                 key=lambda x: x[0])
    letters = []
    while way is not None:
        letters.append(chr(way[0] + 96) if way[0] else " ")
        way = way[1]
    return "".join(reversed(letters)).split()


def other_script(word: str) -> list[str]:
    """The word's parts between punctuation and symbols, and the pairs of neighbouring characters of scripts without spaces."""
    kept = [" " if (k := unicodedata.category(c))[0] in "PSZ" else "" if k == "Cf" else c for c in unicodedata.normalize("NFKC", word)]
    parts = "".join(kept).split()
    return parts + [run[i:i + 2] for part in parts for run in UNSPACED.findall(part) for i in range(len(run) - 1) if len(part) > 2]


def restored(word: str, costs: list[float]) -> list[str]:
    """The words that a white-space-free token stands for; a word with diacritics is also read without."""
    plain = word.lower().strip(EDGE).rstrip("!")
    w = fold(plain)
    if w.isascii() and w.isalpha():
        return decode(w, costs) if TRIPLE.search(w) else list(dict.fromkeys([plain, w]))
    if NUMBER.fullmatch(w):
        return []
    foreign = [] if w.isascii() else [c for c in w if c.isalpha() and not "a" <= c <= "z"]
    latin = any("a" <= c <= "z" for c in w)
    if foreign and not latin:
        return other_script(plain)
    for signs, letter in DRAWN.items():
        w = w.replace(signs, letter)
    if not latin and not any("a" <= c <= "z" or c in SIGNS for c in w):
        return []
    return decode(w, costs) + (other_script(plain) if any(c not in LOOKALIKE for c in foreign) else [])


def path_cost(words: str, costs: list[float]) -> float:
    """The trigram costs of words of a to z with single spaces."""
    s = [0, 0] + [0 if c == " " else ord(c) - 96 for c in words] + [0]
    return sum(costs[a * 729 + b * 27 + c] for a, b, c in zip(s, s[1:], s[2:]))


def joining_cost(parts: list[str], costs: list[float]) -> float:
    """What words of a to z cost as one word, less what they cost as they are."""
    return path_cost("".join(parts), costs) - path_cost(" ".join(parts), costs) + (len(parts) - 1) * (MARK_DROPPED - BOUNDARY_KEPT)


def part(token: str) -> tuple[str, str]:
    """The letters of a token with its signs, and the squeezed letters ("" where it has signs); two "" if it can't
    be a part of a word of a to z."""
    w = fold(token.strip(EDGE).rstrip("!"))
    if w.isascii() and w.isalpha():
        return w, DOUBLE.sub(r"\1", w)
    w = "" if NUMBER.fullmatch(w) else "".join(c for c in w if c.isalpha() or c in SIGNS)
    if w.isascii() and w.isalpha():
        return w, DOUBLE.sub(r"\1", w)
    return ("", "") if not all("a" <= c <= "z" or c in SIGNS or c in LOOKALIKE for c in w) else (w, "")


def features(word: str) -> list[str]:
    """The squeezed word and ``prefix*`` for its prefixes."""
    word = DOUBLE.sub(r"\1", word)
    return [word] + [f"{word[:k]}*" for k in PREFIXES if len(word) > k] if len(word) > 1 else []


class Remembered(dict):
    """Values by key; of ``size`` keys at most the older half goes (two generations, the used ones move to the younger)."""

    def __init__(self, make: Callable, size: int = REMEMBERED):
        self.make, self.half, self.old = make, size // 2, {}

    def __missing__(self, key):
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        value = self[key] = self.old[key] if key in self.old else self.make(key)
        return value


class Finder:
    """Finds a text's features (those of ``only``, if given).

    ``written``: words and prefixes of its tokens and of runs of single characters. Called with a text it also gives
    ``prefix**`` for prefixes that begin two or more words, and reads neighbouring tokens in every way
    that spells a feature of ``only``.
    """

    def __init__(self, costs: list[float], only: frozenset[str] | None = None):
        self.costs, self.only = costs, only
        bare = [] if only is None else [f.rstrip("*") for f in only]
        #: First letters that a feature may have: up to as many as the shortest prefix, and up to all.
        self.starts = frozenset(f[:k] for f in bare for k in range(1, PREFIXES[0] + 1))
        self.beginnings = frozenset(f[:k] for f in bare for k in range(1, len(f) + 1))
        self.whole = frozenset(bare)
        self.goes_on = Remembered(self._goes_on)
        #: Prefixes whose number of words in a text tells something.
        self.repeated = frozenset(f[:-1] for f in only or () if f.endswith("**"))
        self.young, self.old = set(), set()
        self.heads = Remembered(lambda head: DOUBLE.sub(r"\1", head) in self.starts, REMEMBERED // 4)
        self.tokens = Remembered(self._token, REMEMBERED // 4)
        self.parts = Remembered(part, REMEMBERED // 4)
        self.gaps = Remembered(lambda key: joining_cost(list(key), costs), REMEMBERED // 4)
        self.signs = Remembered(lambda key: decode(key, costs), REMEMBERED // 4)

    def known(self, word: str) -> list[str]:
        only = self.only
        if only is None:
            return features(word)
        return [f for f in features(word) if f in only or f + "*" in only] if self.heads[word[:PREFIXES[0]]] else []

    def _begins(self, signs: str) -> bool:
        """Whether any reading of letters and signs is the beginning of a feature."""
        read = {""}
        for options in lattice(signs):
            read = {done if symbol <= 0 or done[-1:] == chr(symbol + 96) else done + chr(symbol + 96) for done in read for symbol, _ in options}
            read = {done for done in read if not done or done in self.beginnings}
            if not read:
                return False
        return bool(read - {""})

    def _token(self, token: str) -> tuple[list[str], tuple[str, str] | None]:
        """The features of a token, and, if it may begin a word that goes on in the next token, its letters and its squeezed
        letters ("" where it has signs)."""
        plain = token.strip(EDGE).rstrip("!")
        w = fold(plain)
        if self.only is None:
            return [f for x in restored(token, self.costs) for f in features(x)], None
        if w.isascii() and w.isalpha():
            here = self.heads[w[:PREFIXES[0]]]
            if not here and (w == plain or not self.heads[plain[:PREFIXES[0]]]):
                return [], None
            squeezed = DOUBLE.sub(r"\1", w)
            return [f for x in restored(token, self.costs) for f in self.known(x)], (w, squeezed) if squeezed in self.beginnings else None
        found = [f for x in restored(token, self.costs) for f in self.known(x)]
        raw, squeezed = part(token)
        starts = bool(raw) and (squeezed in self.beginnings if squeezed else self._begins(raw))
        return found, (raw, squeezed) if starts else None

    def _goes_on(self, key: tuple[str, str]) -> bool:
        """Whether letters that begin a feature may go on with a token that begins so: as far as it begins with
        letters, these must be the feature's until it is complete."""
        squeezed, letters = key
        for letter in letters if squeezed else "":
            if not "a" <= letter <= "z":
                break
            if letter != squeezed[-1]:
                squeezed += letter
                if squeezed not in self.beginnings:
                    return False
                if squeezed in self.whole:
                    break
        return True

    def dropped(self, a: str, b: str) -> bool:
        """Whether the boundary between two parts may be dropped: where both have two letters, if that is likelier by
        the letters around it; else the whole word decides."""
        return len(a) < 2 or len(b) < 2 or self.gaps[a[-2:], b[:2]] < 0

    def from_token(self, tokens: list[str], i: int) -> Iterator[str]:
        """Features of ``only`` that token ``i`` makes with those after it, where that is the likelier reading; tokens are
        added while all that is read begins a feature, a prefix being complete with the token that passes it."""
        raw, squeezed = self.parts[tokens[i]]
        parts = [raw]
        for j in range(i + 1, len(tokens)):
            more, letters = self.parts[tokens[j]]
            if not more or squeezed and letters and not self.dropped(parts[-1], more):
                return
            parts.append(more)
            squeezed = squeezed and letters and squeezed + (letters[1:] if squeezed[-1] == letters[0] else letters)
            if squeezed:
                found = self.known(squeezed)
                if found and (min(map(len, parts)) > 1 or joining_cost(parts, self.costs) < 0):
                    yield from found
                if squeezed not in self.beginnings:
                    return
            else:
                words = self.signs[" ".join(parts)]
                if len(words) == 1:
                    yield from self.known(words[0])
                if not self._begins("".join(parts)):
                    return

    def of_run(self, run: list[str]) -> list[str]:
        """Features of three or more single characters."""
        spaced = fold(" ".join(run))
        words = decode(spaced, self.costs) if re.search("[a-z]", spaced) else restored("".join(run), self.costs)
        return [f for w in words for f in self.known(w)]

    def _telling(self, tokens: list[str]) -> list[tuple[str, list[str], tuple[str, str] | None]]:
        """(token, its features, what it begins) of the different tokens that have either, and of single characters. Tokens that
        have neither are only looked up in sets."""
        out = []
        for token in set(tokens).difference(self.young, self.old):
            found, begins = self.tokens[token]
            if found or begins is not None or len(token) == 1:
                out.append((token, found, begins))
            else:
                if len(self.young) >= REMEMBERED:
                    self.young, self.old = set(), self.young
                self.young.add(token)
        return out

    def _runs(self, tokens: list[str], telling: list) -> list[str]:
        """Features of all runs of three and more single characters."""
        single = {t for t, _, _ in telling if len(t) == 1}
        ones, out, begin = [i for i, t in enumerate(tokens) if t in single] if single else [], [], 0
        for k in range(1, len(ones) + 1):
            if k == len(ones) or ones[k] != ones[k - 1] + 1:
                if k - begin >= 3:
                    out += self.of_run(tokens[ones[begin]:ones[k - 1] + 1])
                begin = k
        return out

    def written(self, text: str) -> set[str]:
        tokens = text.lower().split()
        telling = self._telling(tokens)
        found = set().union(*[f for _, f, _ in telling], self._runs(tokens, telling))
        return found if self.only is None else found & self.only

    def __call__(self, text: str) -> list[str]:
        counts: Counter = Counter()
        tokens = text.lower().split()
        telling = self._telling(tokens)
        number = Counter(tokens).__getitem__ if len(telling) > 20 else tokens.count
        for token, found, _ in telling:
            if found:
                times = 1 if self.repeated.isdisjoint(found) else number(token)
                for f in found:
                    counts[f] += times
        counts.update(self._runs(tokens, telling))
        starters = {t: b for t, _, b in telling if b is not None}
        if starters:
            goes_on = self.goes_on
            for i in [i for i, t in enumerate(tokens[:-1]) if t in starters]:
                (raw, squeezed), start = starters[tokens[i]], tokens[i + 1][:3]
                if goes_on[squeezed, start] and (not squeezed or not start[:2].isalpha() or not start.isascii() or self.dropped(raw, start)):
                    counts.update(self.from_token(tokens, i))
        return [f for f in counts if f in self.only] + [f + "*" for f, n in counts.items() if n > 1 and f + "*" in self.only]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, train_rows: int) -> DataFrame:
    """(text, toxic) of about ``train_rows`` labelled rows at most; the labels are broadcast, bounded by that."""
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(
        F.col("doc_id").alias("__id")).agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, train_rows / max(1, marks.count()))
    few = marks.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return docs.select(F.col(doc_id).alias("__id"), text_or_empty(F.col(text)).alias("text")).join(
        F.broadcast(few), "__id").select("text", "toxic")


def feature_counts(rows: DataFrame, costs: list[float], only: frozenset[str] | None) -> DataFrame:
    """(feature, n): in how many texts each feature (of ``only``) is written."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        finder = Finder(costs, only)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update(finder.written(text))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["feature", "n"])

    return rows.select("text").mapInArrow(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def least_g(tested: int) -> float:
    """The G statistic that a feature needs to be beyond chance among so many."""
    return 2 * math.log(20 * max(1, tested))


def testable(spread: list[tuple[int, int]], base: float) -> tuple[int, int]:
    """How many features a test for all of them must count, and how many toxic rows each of these has at least.

    A feature of t toxic and no clean rows has G = 2 t log(1 / base), and others of t less: so features with fewer toxic
    rows than that asks for can't pass, whatever their clean rows, and don't count as tested (Tarone's
    correction). ``spread``: (t, features with t toxic rows), rising.
    """
    tested = 0
    for t, n in reversed(spread):
        if 2 * t * math.log(1 / base) < least_g(tested + n):
            return max(1, tested), t + 1
        tested += n
    return max(1, tested), 1


def telling(t: np.ndarray, c: np.ndarray, toxic: int, clean: int, tested: int) -> np.ndarray:
    """The G statistic of each feature against the base rate; 0 unless beyond chance over all ``tested``."""
    n, base = t + c, toxic / max(1, toxic + clean)
    p = t / n
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (t * np.log(p / base) + np.where(c > 0, c * np.log((1 - p) / (1 - base)), 0))
    return np.where((p > base) & (g >= least_g(tested)), g, 0)


def logistic(row: np.ndarray, feature: np.ndarray, y: np.ndarray, k: int, steps: int = 400) -> np.ndarray:
    """Intercept and ``k`` weights of an L2-penalised logistic regression on 0/1 features, by Adam."""
    w, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    w[0] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for i in range(1, steps + 1):
        z = w[0] + np.bincount(row, w[1:][feature], len(y))
        err = 1 / (1 + np.exp(-z)) - y
        g = np.concatenate([[err.sum()], np.bincount(feature, err[row], k) + RIDGE * w[1:]]) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9 ** i)) / (np.sqrt(v / (1 - 0.99 ** i)) + 1e-9)
    return w


class Model:
    """What tasks need, all of bounded size: trigram costs, feature weights and the intercept."""

    def __init__(self, costs: list[float], weight: dict[str, float], intercept: float):
        self.costs, self.weight, self.intercept = costs, weight, intercept

    def scorer(self) -> Callable[[str], float]:
        find = Finder(self.costs, frozenset(self.weight))
        return lambda text: 1 / (1 + math.exp(-max(-700.0, self.intercept + sum(self.weight[f] for f in find(text)))))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        train_rows: int = TRAIN_ROWS) -> Model:
    task_memory(docs.sparkSession)
    costs = trigram_costs(count_trigrams(docs.select(text_or_empty(F.col(text)))))
    # copies tell no more than one text does
    rows = stored(training_rows(docs, labels, doc_id, text, train_rows).dropDuplicates(["text", "toxic"]), "training")
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sum(n for k, n in sizes.items() if k), sizes.get(0, 0)
    if not toxic:
        return Model(costs, {}, NOTHING)
    if not clean:
        return Model(costs, {}, -NOTHING)
    first = stored(feature_counts(rows.filter("toxic <> 0"), costs, None), "first")
    spread = sorted((r.n, r.features) for r in first.groupBy("n").agg(F.count(F.lit(1)).alias("features")).collect())  # at most a row for each toxic row
    tested, least = testable(spread, toxic / (toxic + clean))
    t = {r.feature: r.n for r in first.filter(F.col("n") >= least).collect()}
    # G falls as c grows: a tenth of the clean rows rules out most others
    wave = F.pmod(F.xxhash64("text"), F.lit(10)) == 0
    c: Counter = Counter()
    for part in (wave, ~wave):
        c.update({r.feature: r.n for r in feature_counts(rows.filter("toxic = 0").filter(part), costs, frozenset(t)).collect()})
        names = sorted(t)
        g = telling(np.array([t[f] for f in names], float), np.array([c[f] for f in names], float), toxic, clean, tested)
        t = {f: t[f] for f, x in zip(names, g) if x > 0}
    chosen = sorted([*t, *(f + "*" for f in t if f.endswith("*"))])
    place = {f: i for i, f in enumerate(chosen)}

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(costs, frozenset(chosen))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(
                [sorted(place[f] for f in finder(text)) for text in batch.column(0).to_pylist()], pa.list_(pa.int32()))], ["toxic", "at"])

    # about train_rows rows of a label and a few numbers
    seen = rows.mapInArrow(active, "toxic int, at array<int>").collect()
    y = np.array([r.toxic != 0 for r in seen], float)
    at = [np.array(r["at"], np.int64) for r in seen]
    w = logistic(np.repeat(np.arange(len(at)), [len(x) for x in at]), np.concatenate(at), y, len(chosen))
    return Model(costs, dict(zip(chosen, map(float, w[1:]))), float(w[0]))


def score_column(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = model.scorer()
        for batch in batches:
            yield batch.map(score).astype("float64")

    return toxicity(text_or_empty(text))


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
             train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, doc_id, text, train_rows)
    scored = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"),
                         score_column(model, F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
               train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` with a score below 0.5, with its columns."""
    model = fit(docs, labels, doc_id, text, train_rows)
    return docs.filter(score_column(model, F.col(text)) < 0.5)
