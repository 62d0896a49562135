"""Toxicity by a weighted lexicon, matched with Aho-Corasick in folded text."""

from __future__ import annotations

import math
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.base import Workspace
from vertexloom.session import ship

#: Fixed folding: look-alike letters and digits to the letters they stand for.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ι": "i", "κ": "k", "ν": "v",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i",
}
_FOLD = str.maketrans(LOOKALIKES)
#: Characters taken out of words: joiners, soft hyphens and marks that split letters.
_HIDDEN = str.maketrans("", "", "­​‌‍⁠﻿*_")


#: Fixed list: phrases in which a harsh word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "take out the trash", "clown fish", "class clown", "stupid question", "pond scum", "sore loser")


def fold(text: str) -> str:
    """Lower case words of letters, one space apart and around.

    Look-alikes and digits are folded only in words that also hold a Latin letter, so numbers
    stay numbers; other punctuation ends a word.
    """
    out = []
    for w in text.lower().translate(_HIDDEN).split():
        if not w.isalpha() or not w.isascii():
            if any("a" <= c <= "z" for c in w):
                w = w.rstrip("!?.,;:").translate(_FOLD)
            w = "".join(c if c.isalpha() else " " for c in w)
        out.append(w)
    return " " + " ".join(" ".join(out).split()) + " "


#: Stands for every text among the counted terms.
ANY = ""


def terms(folded: str, stem: int = 5) -> dict[str, int]:
    """Candidate lexicon terms of a folded text, its words and the first letters of longer ones; with a hash of the words around the first occurrence of each."""
    ws = folded.split()
    out = {ANY: zlib.crc32(" ".join(ws[:8]).encode())}
    seen = set()
    for i, w in enumerate(ws):
        if w not in seen:
            seen.add(w)
            around = zlib.crc32(" ".join(ws[max(0, i - 1) : i + 2]).encode())
            for t in (f" {w} ", *([f" {w[:stem]}"] if len(w) > stem else ()), *([f" {w[:4]}"] if len(w) > 4 else ())):
                out.setdefault(t, around)
    return out


_COUNTED = "term string, half int, around long, good long"


def _count_terms(batches):
    """Per term: good texts that hold it, and (good 0) the different surroundings it has in toxic ones."""
    import pyarrow as pa

    for b in batches:
        good: dict[tuple[str, int], int] = {}
        bad = set()
        for text, toxic, half in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "half")), strict=True):
            found = terms(fold(text or ""))
            if toxic:
                bad.update((t, half, c) for t, c in found.items())
            else:
                for t in found:
                    good[t, half] = good.get((t, half), 0) + 1
        rows = [(t, h, None, n) for (t, h), n in good.items()] + [(t, h, c, 0) for t, h, c in bad]
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["term", "half", "around", "good"])


class Lexicon:
    """Weighted terms, phrases that excuse what they hold, and the curve from weight to score."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = (), bias: float = -4.85, slope: float = 1.0, per_words: int = 400):
        self.weights, self.exceptions, self.bias, self.slope, self.per_words = weights, exceptions, bias, slope, per_words

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for t, w in self.weights.items():
            a.add_word(t, (len(t), w))
        for t in self.exceptions:
            a.add_word(f" {fold(t).strip()} ", (len(fold(t)), None))
        a.make_automaton()
        return a

    def matches(self, a, folded: str) -> list[tuple[int, int, float]]:
        """(from, to, weight) of matched terms, those inside exception phrases left out."""
        if not len(a):
            return []
        hits, excused = [], []
        for end, (n, w) in a.iter(folded):
            (excused if w is None else hits).append((end - n + 1, end, w))
        return [x for x in hits if not any(lo <= x[0] and x[1] <= hi for lo, hi, _ in excused)]

    def raw(self, a, text: str) -> float:
        """Sum of matched weights in a text, normalised by its length."""
        folded = fold(text)
        return self.normed(sum(w for _, _, w in self.matches(a, folded)), folded.count(" ") - 1)

    def normed(self, total: float, words: float) -> float:
        """Weights of a text of per_words words count in full; of one four times as long by half."""
        return total / math.sqrt(max(1.0, words / self.per_words))

    def score(self, raw: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * raw))))


class _Choice:
    """Terms far more frequent in toxic texts than in others, from counts {term: (bad, good)} of n_bad and n_good texts."""

    def __init__(self, least_docs: int, least_odds: float, least_bound: float, z: float, most_terms: int):
        self.least_docs, self.least_odds, self.least_bound, self.z, self.most_terms = least_docs, least_odds, least_bound, z, most_terms

    def weights(self, counts: dict[str, tuple[int, int]], n_bad: int, n_good: int) -> dict[str, float]:
        best: dict[str, tuple[int, float]] = {}
        for t, (bad, good) in counts.items():
            odds = ((bad + 0.5) / (n_bad + 1)) / ((good + 0.5) / (n_good + 1))
            error = math.sqrt(max(0.0, 1 / (bad + 0.5) + 1 / (good + 0.5) - 1 / (n_bad + 1) - 1 / (n_good + 1)))
            if bad >= self.least_docs and odds >= self.least_odds and math.log(odds) - self.z * error >= math.log(self.least_bound):
                best[t] = (bad, odds)
        best = dict(sorted(best.items(), key=lambda x: (-math.log(x[1][1]) * math.sqrt(x[1][0]), x[0]))[: self.most_terms])
        stems: list[str] = []
        for t in sorted((t for t in best if not t.endswith(" ")), key=lambda t: (-len(t), t)):
            words = [b for w, (b, _) in best.items() if w.endswith(" ") and w.startswith(t)]
            longer = [best[s][0] for s in stems if s.startswith(t)]
            if best[t][0] >= 1.5 * max(words, default=0) and best[t][0] >= 1.1 * sum(longer):
                stems = [s for s in stems if not s.startswith(t)] + [t]
        kept = stems + [t for t in best if t.endswith(" ") and not any(t.startswith(s) for s in stems)]
        return {t: math.log(best[t][1]) for t in kept}


def _observe(lexicons: list[Lexicon], full: Lexicon):
    """Counts of what calibration needs: "total:length" of each text by the lexicon its half didn't teach, and the phrases around matches of the full one."""

    def run(batches):
        import pyarrow as pa

        halves, whole = [x.automaton() for x in lexicons], full.automaton()
        for b in batches:
            seen: dict[tuple[str, str], list[int]] = {}
            for text, toxic, half in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "half")), strict=True):
                folded, side = fold(text or ""), 0 if toxic else 1
                total = min(60.0, sum(w for _, _, w in lexicons[1 - half].matches(halves[1 - half], folded)))
                seen.setdefault(("raw", f"{round(2 * total)}:{(folded.count(' ') - 1).bit_length()}"), [0, 0])[side] += 1
                phrases = set()
                for lo, _, _ in full.matches(whole, folded):
                    end = folded.index(" ", lo + 1)
                    word, before, after = folded[lo + 1 : end], folded[:lo].rpartition(" ")[2], folded[end + 1 :].partition(" ")[0]
                    phrases |= {f"{before} {word}"} if before else set()
                    phrases |= {f"{word} {after}"} if after else set()
                for x in phrases:
                    seen.setdefault(("phrase", x), [0, 0])[side] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([x for _, x in seen], pa.string()), *[pa.array([x[i] for x in seen.values()], pa.int64()) for i in (0, 1)]], ["kind", "what", "bad", "good"])

    return run


def fit(bins: list[tuple[float, int, int]]) -> tuple[float, float, float]:
    """(bias, slope, loss) of the logistic curve for (raw, bad, good), slope held near 1 where the data are few."""
    n = sum(b + g for _, b, g in bins)
    bias, slope = math.log((sum(b for _, b, _ in bins) + 0.5) / (sum(g for _, _, g in bins) + 0.5)), 1.0
    for _ in range(60):
        ga, gb, haa, hab, hbb = 0.0, slope - 1.0, 1e-6, 0.0, 1.0
        for x, bad, good in bins:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + slope * x))))
            w = (bad + good) * p * (1 - p)
            d = (bad + good) * p - bad
            ga, gb, haa, hab, hbb = ga + d, gb + d * x, haa + w, hab + w * x, hbb + w * x * x
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-12))
        bias, slope = bias - step * da, slope - step * db
        if max(abs(da), abs(db)) < 1e-9:
            break
    loss = 0.0
    for x, bad, good in bins:
        z = max(-30.0, min(30.0, bias + slope * x))
        loss += bad * math.log1p(math.exp(-z)) + good * math.log1p(math.exp(z))
    return bias, slope, loss / max(1, n)


def learn(labelled: DataFrame, most_terms: int = 2000, least_docs: int = 5, least_odds: float = 8.0, least_bound: float = 4.0, z: float = 1.645, exceptions: tuple[str, ...] = EXCEPTIONS, most_phrases: int = 500) -> Lexicon:
    """A lexicon from rows of (text, toxic): terms far more frequent in toxic texts than in others, and its curve from weight to score.

    Counts cover all labelled rows; at most 2 * most_terms terms, the weightiest, reach the driver. Of toxic texts the different
    surroundings of a term's first occurrence are counted, so copies of one text teach its words once.
    A term needs least_docs of these, odds of least_odds and a lower bound of them (z standard errors of their
    logarithm down) of least_bound, so a minority's terms aren't measured by all toxic texts. A stem enters only where
    it has half as many texts again as any one of its words, so that "path" isn't learnt
    from "pathetic" but unseen endings of an inflected insult still match.

    Bias, slope and the length from which weights are normalised are fitted on the same rows, each half scored by a lexicon of the
    other half. Phrases of two words around a match that are at least as frequent in texts that aren't toxic (five of these
    or more) become exceptions, at most most_phrases. Without both kinds of rows the lexicon is empty, and every text gets a score of 0.01.
    """
    ship(labelled.sparkSession)
    rows = labelled.where(F.col("toxic").isNotNull()).select("text", (F.col("toxic") == 1).alias("toxic"), F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"))
    each = rows.mapInArrow(_count_terms, _COUNTED).groupBy("term", "half", "around").agg(F.sum("good").alias("good"))
    counted = [F.count_if((F.col("half") == h) & F.col("around").isNotNull()).alias(f"bad{h}") for h in (0, 1)] + [F.sum(F.when(F.col("half") == h, F.col("good")).otherwise(0)).alias(f"good{h}") for h in (0, 1)]
    counts = Workspace(labelled.sparkSession, "terms").keep(each.groupBy("term").agg(*counted), "counts")
    every = counts.where(F.col("term") == ANY).first()
    n = {(h, t): every[f"{'bad' if t else 'good'}{h}"] if every else 0 for h in (0, 1) for t in (True, False)}
    n_bad, n_good = n[0, True] + n[1, True], n[0, False] + n[1, False]
    if not n_bad or not n_good:
        return Lexicon({}, exceptions)
    bad, good = F.col("bad0") + F.col("bad1"), F.col("good0") + F.col("good1")
    odds = ((bad + 0.5) / (n_bad + 1)) / ((good + 0.5) / (n_good + 1))
    top = counts.where((bad >= least_docs) & (F.col("term") != ANY)).where(odds >= least_odds).orderBy(F.desc(F.log(odds) * F.sqrt(bad)), "term").limit(2 * most_terms).collect()
    choice = _Choice(least_docs, least_odds, least_bound, z, most_terms)
    halves = [Lexicon(choice.weights({r.term: (r[f"bad{h}"], r[f"good{h}"]) for r in top}, n[h, True], n[h, False]), exceptions) for h in (0, 1)]
    full = Lexicon(choice.weights({r.term: (r.bad0 + r.bad1, r.good0 + r.good1) for r in top}, n_bad, n_good), exceptions)
    observed = rows.mapInArrow(_observe(halves, full), "kind string, what string, bad long, good long").groupBy("kind", "what").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    bins = observed.where("kind = 'raw'").collect()  # at most 121 totals by 64 lengths
    harmless = (F.col("good") + 0.5) / (n_good + 1) >= (F.col("bad") + 0.5) / (n_bad + 1)
    phrases = observed.where((F.col("kind") == "phrase") & (F.col("good") >= 5) & harmless).orderBy(F.desc("good"), "what").limit(most_phrases).collect()
    full.exceptions = tuple(dict.fromkeys([*exceptions, *[r.what for r in phrases]]))
    best = None
    for per_words in (50, 100, 200, 400, 800, 1600):
        full.per_words = per_words
        points = [(full.normed(int(r.what.split(":")[0]) / 2, 0.75 * 2 ** int(r.what.split(":")[1])), r.bad, r.good) for r in bins]
        got = fit(points)
        if best is None or got[2] < best[0][2]:
            best = got, per_words
    (full.bias, full.slope, _), full.per_words = best
    return full


def sample_labels(labels: DataFrame, most_rows: int = 25_000, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(doc_id, toxic), one row per labelled document, of at most about most_rows documents chosen by the hash of their id.

    most_rows bounds what a lexicon is fitted on, and so what is broadcast: at most that many rows are
    expected, and a few hundredths more have no chance to speak of. Up to most_rows, all labels are used. Null ids and
    null labels are left out; an id labelled twice is toxic if one of its labels says so.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic"))
    share = min(1.0, most_rows / max(1, rows.count()))
    kept = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return kept.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def _score(lexicon: Lexicon):
    def run(batches):
        import pyarrow as pa

        a = lexicon.automaton()
        for b in batches:
            got = [lexicon.score(lexicon.raw(a, t or "")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.float64())], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted (1 if score >= threshold), one row per row of docs, whole texts.

    Null and empty texts match nothing and get the lowest score; null and repeated ids keep
    their rows; an empty table gives none; other columns are not read. Texts of any length are folded and matched whole, by one
    task in time that grows with them.
    """
    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(_score(lexicon), "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
