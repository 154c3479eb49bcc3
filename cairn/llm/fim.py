"""Fill-in-the-middle: documents cut at line ends into prefix, middle and suffix."""

from __future__ import annotations

import re

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A text is a repetition of lines, the last of which may lack its end.
LINES = r"[^\n]*\n|[^\n]+"
SENTINELS = ("<P>", "<S>", "<M>")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four whole numbers below 2^32: the first four 8-digit groups of sha256(`seed:doc_id`). A null id adds nothing after the colon."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9, 17, 25)]


def cuts(unit: str):
    """A function of (text, one, two): the number of units, and where in code points the prefix and the middle end.

    One fullmatch of (unit)* keeps every repetition of the group, so the list of its ends holds the number of units and
    both offsets. A text that isn't a repetition of the unit is an error.
    """

    @F.pandas_udf("n long, prefix_end long, middle_end long")
    def cut(text: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
        whole, rows = regex.compile(f"({unit})*"), []
        for t, a, b in zip(text, one, two, strict=True):
            ends = whole.fullmatch(t).ends(1)
            lo, hi = sorted((a % (len(ends) + 1), b % (len(ends) + 1)))
            rows.append((len(ends), ends[lo - 1] if lo else 0, ends[hi - 1] if hi else 0))
        return pd.DataFrame(rows, columns=["n", "prefix_end", "middle_end"], dtype="int64")

    return cut


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, unit: str = LINES, sentinels=SENTINELS) -> DataFrame:
    """Adds n, form, prefix_chars, middle_chars and output to the columns of `docs` (doc_id, text, any others).

    Each text is cut into n units; two draws by id say after how many of them the prefix and the middle end, a third
    whether it is transformed (`rate` percent), a fourth whether as spm (`spm_rate` percent; else psm). output is the
    text (plain), prefix, suffix, middle (psm) or suffix, prefix, middle (spm), each part after its sentinel. Parts may
    be empty. Null and empty texts, and texts that hold a sentinel, are plain; null counts as empty. prefix_chars and
    middle_chars count code points, and are null for plain. Rows that repeat an id repeat its draws, rows without one
    share theirs; an empty table gives none. Columns of docs with the names of new ones are replaced. Only offsets come
    out of Python: texts are cut and joined by Spark.
    """
    if len(set(sentinels)) != 3 or any(not re.fullmatch("<[^<>]+>", s) for s in sentinels):
        raise ValueError("sentinels are three different names in angle brackets")
    kept = docs.drop("n", "form", "prefix_chars", "middle_chars", "output")
    text = F.coalesce(F.col("text"), F.lit(""))
    one, two, three, four = draws(F.col("doc_id"), seed)
    held = [F.contains(text, F.lit(s)) for s in sentinels]
    plain = (text == "") | held[0] | held[1] | held[2] | (three % 100 >= rate)
    form = F.when(plain, "plain").when(four % 100 < spm_rate, "spm").otherwise("psm")
    rows = kept.select("*", form.alias("form"), cuts(unit)(text, one, two).alias("cut_"))
    lo, hi = (F.col(f"cut_.{c}").cast("int") for c in ("prefix_end", "middle_end"))
    prefix, middle, suffix = F.substring(text, F.lit(1), lo), F.substring(text, lo + 1, hi - lo), F.substring(text, hi + 1, F.length(text))
    p, s, m = map(F.lit, sentinels)
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
    cut = F.col("form") != "plain"
    return rows.select(
        *kept.columns, F.col("cut_.n").alias("n"), "form", F.when(cut, lo.cast("long")).alias("prefix_chars"),
        F.when(cut, (hi - lo).cast("long")).alias("middle_chars"), output.otherwise(F.concat(s, suffix, p, prefix, m, middle)).alias("output"),
    )


def restored(output: Column, form: Column, sentinels=SENTINELS) -> Column:
    """The text from an output and its form alone. Parts hold no sentinel, so each stands once, before its part."""
    parts = F.split(output, "|".join(re.escape(s) for s in sentinels), -1)
    first, second, third = (F.try_element_at(parts, F.lit(k)) for k in (2, 3, 4))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, third, second)).when(form == "spm", F.concat(second, third, first))
