"""Full-text search: words by their stems, all of them, phrases, alternatives and exclusions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing in a search.
STOP = "a an and are as at be by for from has have in is it of on or that the this to was were will with".split()
# End of fixed values.


def stem(word: Column) -> Column:
    """A lower-case word without the ending of a plural, -ed or -ing; y at the end as i. Words of three letters or less stay."""
    w = F.regexp_replace(F.regexp_replace(word, "(ss|i)es$", "$1"), "([^s])s$", "$1")
    cut = F.regexp_replace(w, "(?<=[aeiouy].{0,20})(ed|ing)$", "")
    cut = F.when(cut != w, F.regexp_replace(cut, "([^aeioulsz])\\1$", "$1")).otherwise(w)
    return F.when(F.length(word) <= 3, word).otherwise(F.regexp_replace(cut, "(?<=.[^aeiou])y$", "i"))


def stems(text: Column) -> Column:
    """The stems of a text's words, in order; stop words leave a gap (an empty text), so that phrases do not close over them."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.when(w.isin(STOP), "").otherwise(stem(w)))


def _phrase(said: str, held: Column) -> Column | None:
    """Do the words of a phrase stand one after the other? None if it has none that count."""
    words = [w for w in re.split(r"[\W_]+", said.lower()) if w]
    if not set(words) - set(STOP):
        return None
    asked = stems(F.lit(said))
    if len(words) == 1:
        return F.array_contains(held, F.try_element_at(asked, F.lit(1)))
    whole = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    return F.contains(whole(held), whole(asked))


def matches(query: str, held: Column) -> Column:
    """Does a text with these stems fit? Words are all asked for, "words in quotes" as a phrase; ``or`` between two lets either do; -word must not occur."""
    alternatives: list[Column] = []
    now: list[Column] = []
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        if word.lower() == "or" and not minus:
            if now:
                alternatives.append(_all(now))
                now = []
            continue
        part = _phrase(quoted or word, held)
        if part is not None:
            now.append(~part if minus else part)
    if now:
        alternatives.append(_all(now))
    out = F.lit(False)
    for a in alternatives:
        out = out | a
    return out


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out
