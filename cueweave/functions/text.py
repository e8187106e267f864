"""Text canonicalisation as Column expressions.

Everything here stays in the JVM. Only compatibility normalisation (NFKC) has no built-in; `nfkc` is an Arrow UDF that
callers apply once, at the scan, to texts that may need it.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spoken forms of contracted and slurred words.
SPOKEN_FORMS = {
    "'em": "them",
    "'m": "am",
    "'re": "are",
    "'ve": "have",
    "'ll": "will",
    "'d": "would",
    "'cause": "because",
    "ain't": "is not",
    "c'mon": "come on",
    "coulda": "could have",
    "gimme": "give me",
    "gonna": "going to",
    "gotta": "got to",
    "kinda": "kind of",
    "lemme": "let me",
    "outta": "out of",
    "sorta": "sort of",
    "shoulda": "should have",
    "wanna": "want to",
    "woulda": "would have",
    "ya": "you",
    "i'm": "i am",
    "you're": "you are",
    "we're": "we are",
    "they're": "they are",
    "i've": "i have",
    "you've": "you have",
    "we've": "we have",
    "they've": "they have",
    "i'll": "i will",
    "you'll": "you will",
    "we'll": "we will",
    "they'll": "they will",
    "i'd": "i would",
    "you'd": "you would",
    "we'd": "we would",
    "they'd": "they would",
    "he's": "he is",
    "she's": "she is",
    "it's": "it is",
    "that's": "that is",
    "there's": "there is",
    "here's": "here is",
    "what's": "what is",
    "where's": "where is",
    "who's": "who is",
    "how's": "how is",
    "let's": "let us",
    "can't": "can not",
    "won't": "will not",
    "shan't": "shall not",
}
#: Endings that stand for a word of their own.
ENDINGS = {"'ve": "have", "'re": "are", "'ll": "will", "'m": "am", "'d": "would"}
#: Hesitations.
HESITATIONS = ("er", "err", "erm", "uh", "uhh", "um", "umm")
#: Lines that are a cry and no words.
VOCALIZATIONS = ("oof", "hunh", "unh", "huh", "gah", "yah", "rargh", "aaaarraaagh", "yearrgh", "hyargh", "rrarggh", "yeeeaarrggh", "hhyyaarrgghh", "nnnnyyaarrgghh", "aggh", "aarrggh", "wagh", "raaagh", "nooo")
#: Words for sounds that aren't speech.
PARALINGUISTIC = tuple("ah aha ahh argh breath breathing cough coughing coughs gasp gasps giggle giggles groan groans grunt grunts ha hah haha heh hehe hiccup hiccups hm hmm hmmm huh laugh laughing laughs laughter moan moans mm mmm oh ooh pfft sigh sighing sighs sniff sniffs snort snorts sob sobs uh ugh um wheeze wheezes whimper whimpers yawn yawns".split())
PARALINGUISTIC_PATTERN = r"\A(?:(?:ha)+|h+a+h*|h+m+|m+h+|p+f+t+|u+h+|a+h+|o+h+)\z"
#: Capitalised words that are no names.
STOP_WORDS = ("I", "The", "A", "An", "And", "But", "You", "Your", "He", "She", "It", "We", "They", "What", "Where", "When", "Why", "How")


def nfkc(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))

    return run(c)


def _ascii_fold(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())

    return run(c)


def let(value: Column, body) -> Column:
    """body of a value that is worked out once, wherever body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text(c: Column) -> Column:
    """Null counts as empty everywhere."""
    return F.coalesce(c, F.lit(""))


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


def normalized(c: Column) -> Column:
    """Lower case; runs of what is no letter, digit, underscore or apostrophe become one space. Expects NFKC text."""
    straight = F.regexp_replace(text(c), "[’‘]", "'")
    return F.trim(F.regexp_replace(F.lower(straight), r"[^\p{L}\p{N}_']+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def verbal(c: Column) -> Column:
    """Without stage directions in brackets."""
    return squeezed(F.regexp_replace(text(c), r"\([^)]*\)|\[[^\]]*\]", " "))


def _spoken(w: Column) -> Column:
    """The words of one token."""
    table = F.create_map(*[F.lit(x) for k, v in SPOKEN_FORMS.items() for x in (k, v)])
    out = F.when(F.endswith(w, F.lit("n't")) & (F.length(w) > 3), F.concat(F.substr(w, F.lit(1), F.length(w) - 3), F.lit(" not")))
    for end, word in ENDINGS.items():
        out = out.when(F.endswith(w, F.lit(end)) & (F.length(w) > len(end)), F.concat(F.substr(w, F.lit(1), F.length(w) - len(end)), F.lit(f" {word}")))
    return F.coalesce(F.try_element_at(table, w), out.otherwise(w))


def spoken(c: Column, cues: bool = False) -> Column:
    """Normalised text with contractions written out; with cues=True stage directions are dropped first."""
    plain = normalized(verbal(c) if cues else c)
    full = F.array_join(F.transform(words(plain), _spoken), " ")
    return F.when(F.contains(plain, F.lit("'")) | F.arrays_overlap(words(plain), F.array(*[F.lit(k) for k in SPOKEN_FORMS if "'" not in k])), full).otherwise(plain)


def folded(c: Column, cues: bool = False) -> Column:
    """Spoken text with every hesitation written as `hesitation`: the form that scores compare."""
    said = spoken(c, cues)
    fold = F.array_join(F.transform(words(said), lambda w: F.when(w.isin(*HESITATIONS), "hesitation").otherwise(w)), " ")
    return F.when(F.arrays_overlap(words(said), F.array(*map(F.lit, HESITATIONS))), fold).otherwise(said)


def word_count(c: Column) -> Column:
    return F.size(words(normalized(c)))


def spoken_count(c: Column) -> Column:
    return F.size(words(spoken(c, cues=True)))


def is_nonverbal(c: Column) -> Column:
    return text(c).rlike(r"\A\s*\([^)]*\)\s*\z")


def is_vocalization(c: Column) -> Column:
    return is_nonverbal(c) | normalized(c).isin(*VOCALIZATIONS)


def begins_with_cue(c: Column) -> Column:
    return text(c).rlike(r"\A\s*\([^)]*\)")


def ends_with_cue(c: Column) -> Column:
    return text(c).rlike(r"\([^)]*\)\s*\z")


def is_paralinguistic(c: Column) -> Column:
    ws = words(normalized(c))
    return (F.size(ws) > 0) & F.forall(ws, lambda w: w.isin(*PARALINGUISTIC) | w.rlike(PARALINGUISTIC_PATTERN))


def clauses(c: Column) -> Column:
    """Sentences of the spoken text; one that is a hesitation alone joins its neighbours, runs of such joins together.

    Each part is marked as a beginning or as going on, all are joined and cut at the marks: one pass, whatever their number.
    """
    parts = F.transform(F.filter(F.transform(F.split(verbal(c), "[.!?]+"), lambda p: F.trim(p)), lambda p: normalized(p) != ""), lambda p: F.struct(p.alias("said"), normalized(p).isin(*HESITATIONS).alias("lone")))

    def joined(ps: Column) -> Column:
        goes_on = lambda p, i: F.coalesce(p["lone"] | F.get(ps, i - 1)["lone"], F.lit(False))
        marked = F.transform(ps, lambda p, i: F.concat(F.when((i > 0) & goes_on(p, i), " ").otherwise("\x00"), p["said"]))
        return F.when(F.size(ps) > 0, F.split(F.substr(F.array_join(marked, ""), F.lit(2)), "\x00")).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(parts), joined), F.lit(0))


def slug(c: Column, fallback: str = "item") -> Column:
    s = F.lower(F.trim(F.regexp_replace(_ascii_fold(c), "[^A-Za-z0-9]+", "_"), F.lit("_")))
    return F.when(s == "", fallback).otherwise(s)


def name_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def context_display(c: Column, heading: str = "used in multiple contexts:") -> Column:
    """Lines of a context with repeats of its heading dropped, whatever their case."""
    lines = F.transform(F.split(F.trim(text(c)), "\r?\n"), lambda x: F.rtrim(x))
    is_heading = lambda line: F.lower(squeezed(line)) == heading
    first = F.coalesce(F.array_position(F.transform(lines, lambda x: is_heading(x)), F.lit(True)), F.lit(0))
    return F.trim(F.array_join(F.filter(lines, lambda x, i: ~is_heading(x) | (i + 1 == first)), "\n"))


def row_ranges(c: Column) -> Column:
    """Sorted distinct row numbers of a list such as "3-5, 9"; null where it isn't one."""
    plain = F.regexp_replace(text(c), r"\s+", "")
    item = lambda p: F.when(F.contains(p, F.lit("-")), F.sequence(F.substring_index(p, "-", 1).try_cast("int"), F.substring_index(p, "-", -1).try_cast("int"))).otherwise(F.array(p.try_cast("int")))
    rows = F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(plain, ","), item))))
    rising = F.forall(F.split(plain, ","), lambda p: F.coalesce(F.substring_index(p, "-", 1).try_cast("int") <= F.substring_index(p, "-", -1).try_cast("int"), F.lit(False)))
    return F.when(plain == "", F.array().cast("array<int>")).when(plain.rlike(r"\A[1-9]\d{0,8}(-[1-9]\d{0,8})?(,[1-9]\d{0,8}(-[1-9]\d{0,8})?)*\z") & rising, rows)


def written_rows(rows: Column) -> Column:
    """The shortest such list of an array of row numbers."""
    def joined(ordered: Column) -> Column:
        starts = F.filter(ordered, lambda r, i: F.coalesce(r - F.get(ordered, i - 1) > 1, F.lit(True)))
        ends = F.filter(ordered, lambda r, i: F.coalesce(F.get(ordered, i + 1) - r > 1, F.lit(True)))
        return F.array_join(F.zip_with(starts, ends, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("-"), b.cast("string")))), ", ")

    return F.get(F.transform(F.array(F.array_sort(F.array_distinct(rows))), joined), F.lit(0))


def capitalised(c: Column) -> Column:
    """Capitalised words of three letters or more that aren't stop words."""
    found = F.regexp_extract_all(text(c), F.lit(r"(?U)\b([A-Z][A-Za-z'-]{2,})\b"), F.lit(1))
    return F.filter(found, lambda w: ~w.isin(*STOP_WORDS))


def target_filename(c: Column, extension: str = ".wav") -> Column:
    """struct(name, error): a plain file name with the extension, or why it isn't one."""
    name = F.trim(text(c))
    ok = F.when(F.lower(F.substr(name, F.length(name) - len(extension) + 1)) == extension, name).when(F.contains(name, F.lit(".")), None).otherwise(F.concat(name, F.lit(extension)))
    bad = (name == "") | name.rlike(r"[/\\]") | name.isin(".", "..") | ok.isNull()
    return F.struct(F.when(~bad, ok).alias("name"), F.when(bad, "INVALID_TARGET_FILENAME").alias("error"))


def first_text(*cs: Column) -> Column:
    """The first that isn't null or empty, trimmed; else empty."""
    return F.trim(F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit("")))
