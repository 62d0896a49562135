"""Line-first cleaning with DataFrame expressions only.

Each line is judged by punctuation, navigation and boilerplate rules; failing lines go, and a
document that loses too much of its text that way is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.base import WORD_GAP

SYMBOLS = "#*$%&|<>"
#: A line with a word.
WORDED = "[^\\x20\\x09-\\x0D]"
#: Fixed list: phrases of licence, cookie and site furniture lines, in four languages.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "accept cookies", "enable javascript", "click here", "read more", "sign in", "log in", "subscribe to our",
    "share this", "skip to content", "back to top", "lorem ipsum",
    "alle rechte vorbehalten", "lizenziert unter", "nutzungsbedingungen", "datenschutzerklärung", "cookies akzeptieren", "hier klicken", "weiterlesen", "impressum",
    "tous droits réservés", "sous licence", "conditions d'utilisation", "politique de confidentialité", "accepter les cookies", "cliquez ici", "lire la suite", "mentions légales",
    "todos los derechos reservados", "bajo licencia", "términos de uso", "política de privacidad", "aceptar cookies", "haga clic aquí", "leer más", "aviso legal",
)
#: Of lower-case texts behind a line end: a phrase that no letter stands before, by its first letter, so that most places need one look.
PHRASES = "[^a-z](?:" + "|".join(x + "(?:" + "|".join(p[1:] for p in BOILERPLATE if p[0] == x) + ")" for x in sorted({p[0] for p in BOILERPLATE})) + ")"
#: Separators of menus, when they stand alone as words.
SEPARATORS = ("|", "»", ">", "•", "/", "·")
#: The end of a line that is a sentence, or leads to one: looked for in its last LAST characters.
LAST = 8
ENDED = "[.!?…:;,。！？][\"'»”’)\\]]*[\x20\x09-\x0D]*\\z"
#: Without one of these and with a sentence's end, a line can fail by its phrases alone.
MARKS = f"[{SYMBOLS}»/·!?]"


def let(value: Column, body) -> Column:
    """body(value) with value computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text that isn't null."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_GAP))


def repeated_words(ws: Column, k: int = 5) -> Column:
    """Words inside k-word windows that occur twice or more in the text, the first occurrence included."""
    n = F.size(ws)

    def covered(at: Column) -> Column:  # at: sorted starts of repeated windows
        gap = F.transform(at, lambda x, i: F.least(F.lit(k), F.coalesce(F.get(at, i + 1), x + k) - x))
        return F.aggregate(gap, F.lit(0), lambda a, b: a + b)

    def starts(pairs: Column) -> Column:  # pairs: (hash, start), sorted
        same = lambda i, x: F.coalesce(F.get(pairs, i)["h"] == x["h"], F.lit(False))
        kept = F.filter(pairs, lambda x, i: (F.when(i > 0, same(i - 1, x)).otherwise(False)) | same(i + 1, x))
        return F.sort_array(F.transform(kept, lambda x: x["i"]))

    def judged(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(let(pairs, starts), covered))

    def windows(h: Column) -> Column:  # h: hash of each word, less the last k - 1
        return F.transform(F.slice(h, 1, n - k + 1), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]))

    return F.when(n > k, let(let(F.transform(ws, lambda w: F.xxhash64(w)), windows), judged)).otherwise(0)


def phrased(text: Column) -> Column:
    """Whether a text holds a boilerplate phrase."""
    return F.rlike(F.concat(F.lit("\n"), F.lower(text)), F.lit(PHRASES))


def ended(line: Column) -> Column:
    """Whether a line ends as sentences do."""
    return F.rlike(F.substring(line, -LAST, LAST), F.lit(ENDED))


def line_fails(line: Column, furnished: Column) -> Column:
    """True for a line of navigation, boilerplate, shouting, or hardly any words among symbols. furnished: whether the text holds a boilerplate phrase at all.

    Lines without a word never fail. A line fails if: it is short (under 40 words)
    and holds a boilerplate phrase, in any case, that doesn't begin inside a word; it has 3 or more separators ('|', '»', '>' or '•') standing
    alone as words, over a fifth of its words; symbols are over a tenth of its characters;
    most of its words end in '!' or '?' (at least 4 words); or it has under 12 words and doesn't end as sentences do.
    """

    def judged(ws: Column) -> Column:
        n, chars = F.size(ws), F.char_length(line)
        boiler = (n < 40) & furnished & phrased(line)
        seps = F.size(F.filter(ws, lambda w: w.isin(*SEPARATORS)))
        navigation = let(seps, lambda k: (k >= 3) & (k * 5 > n))
        symbols = (chars - F.char_length(F.translate(line, SYMBOLS, ""))) * 10 > chars
        shouts = chars - F.char_length(F.translate(line, "!?", ""))
        return (n > 0) & (symbols | ((n >= 4) & (shouts * 2 > n)) | navigation | boiler | ((n < 12) & ~ended(line)))

    may = ~ended(line) | furnished | F.rlike(line, F.lit(MARKS)) | F.contains(line, F.lit("•"))
    return F.when(may, let(words(line), judged)).otherwise(False)


def gapless(text: Column) -> Column:
    """Characters that aren't white space between words."""
    return F.char_length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long")


def _verdict(text: Column, most_lost: float) -> Column:
    """All of a document's findings in one struct; what is used twice is bound, so nothing is evaluated twice."""

    def cleaned(t: Column) -> Column:
        """The lines that stay; NULL if all do."""
        fails = lambda x: line_fails(x, t["f"])
        return F.when(F.exists(t["l"], fails), F.array_join(F.filter(t["l"], lambda x: ~fails(x)), "\n"))

    def of_words(ws: Column) -> Column:
        worded = let(F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORDED))), lambda x: F.size(x) - F.size(F.array_distinct(x)))
        return let(
            F.struct(
                F.size(ws).cast("long").alias("n_words"),
                F.char_length(F.array_join(ws, "")).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
                worded.cast("long").alias("n_dup_lines"),
                repeated_words(ws).cast("long").alias("n_repeat_words"),
                let(F.struct(phrased(text).alias("f"), F.split(text, "\n").alias("l")), cleaned).alias("cleaned"),
            ),
            judged,
        )

    def judged(v: Column) -> Column:
        failed = (v["n_words"] < 10) | (100 * v["n_repeat_words"] > 20 * v["n_words"])
        lost = F.when(v["cleaned"].isNotNull() & (v["word_chars"] > 0), 1 - gapless(v["cleaned"]) / v["word_chars"]).otherwise(0.0)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return let(F.struct(failed.alias("f"), lost.alias("l")), lambda w: F.struct(*[v[n].alias(n) for n in names], F.coalesce(v["cleaned"], text).alias("clean_text"), w["f"].alias("base_failed"), (~w["f"] & (w["l"] <= most_lost)).alias("kept"), w["l"].alias("lost")))

    return let(words(text), of_words)


def quality(docs: DataFrame, most_lost: float = 0.5, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """All columns' worth of a verdict, one row per row of docs, in a single narrow stage.

    carry names columns of docs to return in a struct doc, so none clashes with the verdict's.
    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and
    clean_text (failing lines removed) with lost (share of word characters in failing lines).
    A null text has no words and so fails the base rules. Ties and repeated rows are judged alike.
    Null ids pass through, an empty table gives no rows, other columns are not read. Texts of any
    length are judged whole, in time that grows as n log n with their words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # A generator is evaluated once, whatever is filtered on or selected from it later.
    d = docs.select(F.col(id_col).alias("doc_id"), *([F.struct(*carry).alias("doc")] if carry else []), F.explode(F.array(let(text, lambda t: _verdict(t, most_lost)))).alias("_v"))
    found = [F.col("_v")[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost", "clean_text")]
    return d.select("doc_id", *found, *(["doc"] if carry else []))
