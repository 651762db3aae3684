"""Text functions as columns: normalisation, error rates, rewriting rules.

Everything is built in but NFC (optional in ``normalize_text``) and the edit
distance of arrays, which Spark lacks: these are Arrow UDFs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

HANGUL = "가-힣ㄱ-ㅎㅏ-ㅣ"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: str | Column) -> Column:
    """White space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(F.btrim(_col(c), F.lit(" \t\r\n")), "[ \t\r\n]+", " "))


def word_array(c: str | Column) -> Column:
    """Words between ASCII white space; none for blank texts."""
    return F.filter(F.split(collapse(c), " "), lambda x: x != "")


def normalize_text(c: str | Column, keep: str = "", with_nfc: bool = False) -> Column:
    """Lower case, marks to spaces (but for those in ``keep``), spaces collapsed."""
    c = nfc(_col(c)) if with_nfc else _col(c)
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), rf"(?U)[^\p{{L}}\p{{N}}_\s{keep}]", " "), r"(?U)\s+", " "))


def normalize_for_bleu(c: str | Column) -> Column:
    return normalize_text(c, keep=".,!?")


def display_text(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def compact_text(c: str | Column) -> Column:
    """Spaces between Hangul removed."""
    return F.regexp_replace(display_text(c), r"(?<=[가-힣])\s+(?=[가-힣])", "")


def edit_rows(ref: list, hyp: list) -> Iterator[np.ndarray]:
    """The rows of the Levenshtein table, a numpy pass each."""
    code: dict = {}
    r, h = (np.array([code.setdefault(x, len(code)) for x in side], dtype=np.int64) for side in (ref, hyp))
    step = np.arange(len(h) + 1)
    row = step
    yield row
    for i, x in enumerate(r):
        best = np.minimum(row[:-1] + (h != x), row[1:] + 1)
        # an insertion costs 1 a place: the least of (value - place) so far, plus the place
        row = np.minimum.accumulate(np.append(i + 1, best) - step) + step
        yield row


@F.pandas_udf(IntegerType())
def edit_distance(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Levenshtein distance of two arrays."""

    def one(r, h):
        if r is None or h is None:
            return None
        for row in edit_rows(list(r), list(h)):
            pass
        return int(row[-1])

    return pd.Series([one(r, h) for r, h in zip(ref, hyp, strict=True)], dtype="Int32")


def word_error_rate(ref: Column, hyp: Column) -> Column:
    """Distance over reference words; without any, 0 for equal and else 1."""
    none = F.when(F.size(hyp) > 0, 1.0).otherwise(0.0)
    return F.when(F.size(ref) > 0, edit_distance(ref, hyp) / F.size(ref)).otherwise(none)


def char_error_rate(ref: str | Column, hyp: str | Column) -> Column:
    """As word error rate over characters, spaces removed."""
    r, h = (F.regexp_replace(_col(c), r"\s", "") for c in (ref, hyp))
    return F.when(F.length(r) > 0, F.levenshtein(r, h) / F.length(r)).otherwise(F.when(F.length(h) > 0, 1.0).otherwise(0.0))


def charset_coverage(a: str | Column, b: str | Column) -> Column:
    """Share of the distinct characters of ``a`` in ``b``; 1 for an empty ``a``."""
    x, y = (F.array_distinct(F.filter(F.split(_col(c), ""), lambda v: v != "")) for c in (a, b))
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x)).otherwise(1.0)


def apply_rules(c: str | Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered regular-expression rewriting; a later rule sees earlier results."""
    out = _col(c)
    for pattern, to in rules:
        out = F.regexp_replace(out, pattern, to)
    return out


def _from_first(c: Column, rules: list[tuple[str, str]], f: Callable[[Column], Column]) -> Column:
    """``f`` of the text from the first character on that begins a rule's match, which is cut once a row however often ``f`` names it.

    Rules other than literal texts (at most anchored to the end) may match anywhere, so their text stays whole.
    """
    import re

    plain = [re.sub(r"\\[?.]|\$$", "", p) for p, _ in rules]
    literal = all(x and p[0] == x[0] and not re.search(r"[\\^$.|?*+()\[\]{}]", x) for x, (p, _) in zip(plain, rules, strict=True))
    starts = "".join(re.escape(x) for x in sorted({p[0] for p, _ in rules}))
    return F.transform(F.array(F.regexp_extract(c, rf"(?s)[{starts}].*", 0) if literal else c), f)[0]


def rule_confidence(c: str | Column, rules: list[tuple[str, str]]) -> Column:
    """min(0.7 + 0.05 * rules that match, 0.9)."""
    hits = lambda x: sum((F.when(F.regexp_like(x, F.lit(p)), 1).otherwise(0) for p, _ in rules), F.lit(0))
    return F.least(F.lit(0.7) + 0.05 * _from_first(_col(c), rules, hits), F.lit(0.9))


def seeded_share(seed: int, *keys: str | Column) -> Column:
    """A number in [0, 1) from md5(seed:keys); equal wherever md5 is."""
    text = F.concat_ws(":", F.lit(str(seed)), *(_col(k).cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def replace_first(c: str | Column, term: str, to: str) -> Column:
    """The first occurrence of a literal term replaced."""
    import re

    return F.regexp_replace(_col(c), rf"(?s)^(.*?){re.escape(term)}", "$1" + to)


def code_switch(c: str | Column, terms: dict[str, str], p: float, seed: int, *keys: str) -> Column:
    """Each term's first occurrence replaced with probability ``p``.

    Where a term isn't drawn its pattern matches nothing, so the text is named
    once a term and the expression stays as long as the list.
    """
    import re

    out = _col(c)
    for k, (term, to) in enumerate(terms.items()):
        pattern = F.when(seeded_share(seed, *keys, F.lit(k)) < p, F.lit(rf"(?s)^(.*?){re.escape(term)}")).otherwise(F.lit("(?!)"))
        out = F.regexp_replace(out, pattern, F.lit("$1" + to))
    return out


def with_filler(c: str | Column, fillers: list[str], p: float, seed: int, *keys: str) -> Column:
    """A filler put in front with probability ``p``."""
    u = seeded_share(seed, *keys)
    pick = F.element_at(F.array(*map(F.lit, fillers)), (F.floor(seeded_share(seed + 1, *keys) * len(fillers)) + 1).cast("int"))
    return F.when(u < p, F.concat(pick, F.lit(", "), _col(c))).otherwise(_col(c))


def format_duration(seconds: str | Column) -> Column:
    """One decimal, rounded as printf does: the double's own value, ties to even."""
    s = _col(seconds).cast("double")
    shown = lambda x, unit: F.concat(F.call_function("format_number", x, F.lit("0.0")), F.lit(unit))
    return F.when(s < 60, shown(s, "s")).when(s < 3600, shown(s / 60, "m")).otherwise(shown(s / 3600, "h"))


def format_size(size: str | Column) -> Column:
    b = _col(size).cast("double")
    mb, gb = 1024.0**2, 1024.0**3
    whole = F.concat(_col(size).cast("string"), F.lit("B"))
    return F.when(b < 1024, whole).when(b < mb, F.format_string("%.1fKB", b / 1024)).when(b < gb, F.format_string("%.1fMB", b / mb)).otherwise(F.format_string("%.1fGB", b / gb))


def spoken(c: str | Column) -> Column:
    """Written Korean to spoken, blank texts as they are.

    No rule matches before the first character that one begins with, and none makes
    such a match, so only the text from there on goes through all of them.
    """
    from turnwise.functions.korean import SPOKEN_RULES

    after = _from_first(_col(c), SPOKEN_RULES, lambda x: F.concat(F.substr(_col(c), F.lit(1), F.length(_col(c)) - F.length(x)), apply_rules(x, SPOKEN_RULES)))
    return F.when(F.trim(_col(c)) == "", _col(c)).otherwise(after)
