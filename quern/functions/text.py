"""Text functions with Unicode-aware blanks, words and digits, equal in Spark and in any engine with the same classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as a blank: also the separators of the C1 and Z classes, which Java's \s leaves out.
BLANK = r"\s\x0B\x1c-\x1f\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
#: The same blanks one by one, for functions that take characters and not a class.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
PHONE = rf"\+?{DIGIT}[{DIGIT}{BLANK}\-()]{{7,}}{DIGIT}"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def _replaced(c: Column, held: list[str], pattern: str, instead: str) -> Column:
    """regexp_replace for texts that hold one of the strings: a search for a string is far cheaper than one for a pattern. The text is used several times, so it's bound to the argument of a lambda function."""

    def one(x: Column) -> Column:
        test = F.contains(x, F.lit(held[0]))
        for h in held[1:]:
            test = test | F.contains(x, F.lit(h))
        return F.when(test, F.regexp_replace(x, pattern, instead)).otherwise(x)

    return F.transform(F.array(c), one)[0]


def word_array(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"[^{BLANK}]+"), F.lit(0))


def word_count(c: Column) -> Column:
    """As many as word_array has, without making them."""
    return F.coalesce(F.regexp_count(c, F.lit(f"[^{BLANK}]+")), F.lit(0)).cast("long")


def clean_message(c: Column, mask_phones: bool = False) -> Column:
    """A message on one line: line ends and the blanks around them become one blank, runs of blanks and tabs too."""
    c = F.regexp_replace(strip(c), rf"[{BLANK}]*\n[{BLANK}]*", " ")
    c = F.regexp_replace(c, r"[ \t]{2,}", " ")
    return strip(F.regexp_replace(c, PHONE, "<phone>") if mask_phones else c)


def clean_document(c: Column, fold_ya: bool = False) -> Column:
    """A document without byte order marks, addresses, mentions, line ends and a trailing ellipsis. The ellipsis goes before runs of blanks are folded, so one that a blank follows stays."""
    c = strip(F.replace(c, F.lit("\ufeff"), F.lit("")))
    steps = [
        (["http", "www."], rf"https?://[^{BLANK}]+|www\.[^{BLANK}]+", " "),
        (["@"], rf"@[{WORD}]+", " "),
        (["\n", "\r"], r"[\r\n]+", " "),
        (["\u2026"], "\u2026+\\z", ""),
    ]
    for step in steps:
        c = _replaced(c, *step)
    if fold_ya:
        c = F.translate(c, "\u0649", "\u064a")
    return strip(F.regexp_replace(c, rf"[{BLANK}]{{2,}}", " "))


def drop_thoughts(c: Column) -> Column:
    """Text without its <think> passages, on one line."""
    return F.regexp_replace(strip(F.regexp_replace(c, "(?s)<think>.*?</think>", "")), "\n", " ")


def speaker(kind: Column, sender: Column, chat: Column) -> Column:
    named = F.coalesce(F.nullif(strip(sender), F.lit("")), F.nullif(strip(chat), F.lit("")), F.lit("UNKNOWN"))
    return F.when(kind == "Outgoing", F.lit("ME")).otherwise(named)


def message_time(c: Column) -> Column:
    """A timestamp without a zone, or null where the text isn't one; one-digit fields are read too."""
    return F.try_to_timestamp(c, F.lit("yyyy-M-d H:m:s")).cast("timestamp_ntz")


def uniform(key: Column, seed: int = 67) -> Column:
    """A number in [0, 2**32) that depends on the seed and the key alone, whatever the partitioning."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long")


def uniform_sql(key: str, seed: int = 67) -> str:
    return f"('0x' || substr(md5('{seed}:' || ({key})::VARCHAR), 1, 8))::BIGINT"


def shuffle_order(key: Column, seed: int = 67) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def strip_sql(c: str) -> str:
    return rf"regexp_replace({c}, '^[{BLANK}]+|[{BLANK}]+\z', '', 'g')"


def word_count_sql(c: str) -> str:
    return rf"coalesce(len(list_filter(regexp_split_to_array(coalesce({c}, ''), '[{BLANK}]+'), x -> x <> '')), 0)::BIGINT"


#: Bytes of texts, or ids, that a Python worker makes objects of at once.
AT_ONCE = 1 << 18


def slices(batches: Iterator[pa.Array]) -> Iterator[list]:
    """The values of Arrow batches of texts or lists as Python objects, as many neighbours at a time as hold AT_ONCE together, and a larger one alone. An encoded token takes some hundred bytes, so a whole batch of 10,000 texts takes gigabytes."""
    for batch in batches:
        length = pc.list_value_length(batch) if pa.types.is_list(batch.type) else pc.binary_length(batch)
        ends, at = np.cumsum(length.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
            yield batch.slice(at, end - at).to_pylist()
            at = end


@F.arrow_udf(T.StringType())
def nfkc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Compatibility normal form, which has no built-in expression."""
    import unicodedata

    for texts in slices(batches):
        yield pa.array([t if t is None else unicodedata.normalize("NFKC", t) for t in texts], pa.string())
