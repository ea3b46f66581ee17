"""Id-array expressions (E3-E8, E10, W8): wrapping, truncation, padding,
shifting, masking and cleaning of token-id arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenmill.constants import BOS_ID, EOS_ID, PAD_ID


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _lit_arr(*vals) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in vals])


def wrap_truncate(col, max_len: int = 128, bos: int = BOS_ID, eos: int = EOS_ID) -> Column:
    """E3 (dataset rule): [bos] + ids[:max_len-2] + [eos]; eos always kept."""
    if max_len < 2:
        raise ValueError("max_len must be >= 2")
    c = _c(col).cast("array<bigint>")
    return F.concat(_lit_arr(bos), F.slice(c, 1, max_len - 2), _lit_arr(eos))


def pad_to(col, length, pad: int = PAD_ID) -> Column:
    """Right-pad an id array with ``pad`` up to ``length`` (never truncates)."""
    c = _c(col).cast("array<bigint>")
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(c, F.array_repeat(F.lit(pad).cast("bigint"), F.greatest(length - F.size(c), F.lit(0))))


def wrap_pad_fixed(col, max_len: int = 128, bos: int = BOS_ID, eos: int = EOS_ID,
                   pad: int = PAD_ID) -> Column:
    """E4 (serving rule): ([bos]+ids+[eos])[:max_len], right-padded to exactly
    max_len. Long input LOSES its eos, unlike E3."""
    if max_len < 1:
        raise ValueError("max_len must be >= 1")
    c = _c(col).cast("array<bigint>")
    cut = F.slice(F.concat(_lit_arr(bos), c, _lit_arr(eos)), 1, max_len)
    return pad_to(cut, max_len, pad)


def teacher_shift(col) -> tuple[Column, Column]:
    """E5: (ids[:-1], ids[1:])."""
    c = _c(col)
    n = F.greatest(F.size(c) - 1, F.lit(0))
    return F.slice(c, F.lit(1), n), F.slice(c, F.lit(2), n)


def pad_mask(col, pad: int = PAD_ID) -> Column:
    """Per position, is it padding."""
    return F.transform(_c(col), lambda x: x == F.lit(pad))


def clean_ids(col, bos: int = BOS_ID, eos: int = EOS_ID, pad: int = PAD_ID) -> Column:
    """Skip pad, stop at the first eos, skip bos, keep the rest."""
    c = _c(col)
    at = F.array_position(c, F.lit(eos))
    head = F.when(at > 0, F.slice(c, F.lit(1), (at - 1).cast("int"))).otherwise(c)
    return F.filter(head, lambda x: (x != F.lit(pad)) & (x != F.lit(bos)))


def char_decode(col, pieces: Column) -> Column:
    """Ids -> characters joined; ``pieces`` is an array<string> indexed by id."""
    return F.array_join(F.transform(_c(col), lambda i: F.element_at(pieces, (i + 1).cast("int"))), "")


def tail_window(col, width: int = 64, pad: int = 0) -> Column:
    """The last ``width`` ids, left-padded with ``pad`` when shorter."""
    c = _c(col)
    return F.when(F.size(c) >= width, F.slice(c, -width, width)).otherwise(
        F.concat(F.array_repeat(F.lit(pad).cast("bigint"), F.lit(width) - F.size(c)), c.cast("array<bigint>")))


def ids_text(col) -> Column:
    """Render an id array as space-separated text (output formatting only)."""
    return F.array_join(F.transform(_c(col), lambda x: x.cast("string")), " ")
