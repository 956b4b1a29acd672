"""Text analysis as Column expressions: markup removal, terms, stems, n-grams."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default stop words; every function takes another list. A deployment with a larger
#: dictionary passes its own, see weft.sources.lists.read_words.
STOP_WORDS: tuple[str, ...] = tuple(
    """a about above after again against all am an and any are as at be because been before being below
    between both but by can cannot could did do does doing down during each few for from further had has have having he her
    here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on
    once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves
    then there these they this those through to too under until up very was we were what when where which while who whom why
    will with would you your yours yourself yourselves""".split()
)

#: White space as a JavaScript regular expression has it, spelled out for engines whose \\s is ASCII only.
_SPACE_CODES = ("00a0", "1680", "2028", "2029", "202f", "205f", "3000", "feff")
JAVA_SPACE = r"[\s\x0b - " + "".join(rf"\u{c}" for c in _SPACE_CODES) + "]+"
RE2_SPACE = r"[\s\x{0b}\x{2000}-\x{200a}" + "".join(rf"\x{{{c}}}" for c in _SPACE_CODES) + "]+"
_BLOCKS = (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"<[^>]+>", r"(?i)&nbsp;")


def html_to_text(html: Column) -> Column:
    """Scripts, styles and tags become spaces, two entities are decoded, white space collapses. Null stays null."""
    for pattern in _BLOCKS:
        html = F.regexp_replace(html, pattern, " ")
    html = F.regexp_replace(html, "(?i)&amp;", "&")
    return F.trim(F.regexp_replace(html, JAVA_SPACE, " "))


def html_to_text_sql(html: str) -> str:
    for pattern in _BLOCKS:
        html = f"regexp_replace({html}, '{pattern}', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({html}, '(?i)&amp;', '&', 'g'), '{RE2_SPACE}', ' ', 'g'))"


def stem(word: Column) -> Column:
    """The first suffix that fits goes: ing of over 4 letters, ed or es of over 3, s of over 2."""
    n = F.length(word)
    drop = lambda k: F.substring(word, F.lit(1), n - k)
    return (
        F.when((n > 4) & F.endswith(word, F.lit("ing")), drop(3))
        .when((n > 3) & (F.endswith(word, F.lit("ed")) | F.endswith(word, F.lit("es"))), drop(2))
        .when((n > 2) & F.endswith(word, F.lit("s")), drop(1))
        .otherwise(word)
    )


def stem_sql(w: str) -> str:
    return (
        f"CASE WHEN length({w}) > 4 AND {w} LIKE '%ing' THEN left({w}, length({w}) - 3) "
        f"WHEN length({w}) > 3 AND ({w} LIKE '%ed' OR {w} LIKE '%es') THEN left({w}, length({w}) - 2) "
        f"WHEN length({w}) > 2 AND {w} LIKE '%s' THEN left({w}, length({w}) - 1) ELSE {w} END"
    )


def tokens(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Lower-case runs of a-z without stop words, in order. Null gives an empty array."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+", " ")), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*stop_words) if stop_words else w != "")


def tokens_sql(text: str, stop_words: Sequence[str] = STOP_WORDS) -> str:
    listed = ", ".join(f"'{w}'" for w in stop_words)
    return f"list_filter(string_split(trim(regexp_replace(lower(coalesce({text}, '')), '[^a-z]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ({listed}))"


def terms(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    return F.transform(tokens(text, stop_words), stem)


def terms_sql(text: str, stop_words: Sequence[str] = STOP_WORDS) -> str:
    return f"list_transform({tokens_sql(text, stop_words)}, lambda w: {stem_sql('w')})"


def terms_of(text: str, stop_words: Sequence[str] = STOP_WORDS) -> list[str]:
    """terms() of a query string, on the driver."""

    def cut(w: str) -> str:
        if len(w) > 4 and w.endswith("ing"):
            return w[:-3]
        if len(w) > 3 and w.endswith(("ed", "es")):
            return w[:-2]
        return w[:-1] if len(w) > 2 and w.endswith("s") else w

    stops = set(stop_words)
    return [cut(w) for w in re.sub("[^a-z]+", " ", text.lower()).split() if w not in stops]


def local_tokens(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """The line-oriented variant: letters are found before lower-casing, so non-ASCII letters never count."""
    words = F.split(F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^a-zA-Z]+", " "))), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*stop_words) if stop_words else w != "")


def ngrams(words: Column, sep: str = " ") -> Column:
    """All runs of one, two and three words, by first word, shorter ones first."""

    def runs(own: Column) -> Column:
        n = F.size(own)

        def at(w: Column, i: Column) -> Column:
            two, three = F.get(own, i + 1), F.get(own, i + 2)
            return F.filter(
                F.array(w, F.when(i + 1 < n, F.concat_ws(sep, w, two)), F.when(i + 2 < n, F.concat_ws(sep, w, two, three))),
                lambda x: x.isNotNull(),
            )

        return F.flatten(F.transform(own, at))

    # bound once: inside a lambda a column expression would be computed again for every word
    return F.transform(F.array(words), runs)[0]


def ngram_bag(words: Column, sizes: Sequence[int] = (1, 2, 3), sep: str = " ") -> Column:
    """The same runs in no order, of the given sizes only: one concatenation a run."""

    def runs(own: Column) -> Column:
        n = F.size(own)
        tail = lambda k: F.slice(own, F.lit(k + 1), F.greatest(n - k, F.lit(0)))
        join = lambda a, b: F.concat(a, F.lit(sep), b)
        # the shorter side ends a pair; what it leaves is null and goes
        two = F.filter(F.zip_with(own, tail(1), join), lambda x: x.isNotNull())
        parts = {1: own, 2: two, 3: F.filter(F.zip_with(two, tail(2), join), lambda x: x.isNotNull())}
        return F.concat(*[parts[k] for k in sorted(set(sizes))])

    return F.transform(F.array(words), runs)[0]
