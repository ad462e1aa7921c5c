r"""Fill-in-the-middle transformation of whole texts in pyarrow.compute (operator 12).

A text's units are its lines `[^\n]*\n|[^\n]+`. Two cuts between units, drawn from the sha256 of seed and doc_id, part it into prefix, middle and
suffix. For each batch the pieces between newlines are list arrays; their values, flattened, get the number of their row and their place in
it; a piece belongs to the role that its place gives; the pieces of a role are gathered into lists again and joined with the newlines that they
had. A document becomes `<P>prefix<S>suffix<M>middle` (psm) or `<S>suffix<P>prefix<M>middle` (spm). It stays plain if it is empty, holds
one of the three marks itself, or its draw is not under the rate. `restore` gets the exact text back from output and form alone.

A null text is an empty one; a null doc_id draws as the empty string. Rows equal in id and text get equal results, each its own row. Columns
other than doc_id and text are not read, an empty table gives no rows. Texts are taken some 16 MB at a time, a longer one by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialgrid.llm.common import lean

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_AT_ONCE = 1 << 24
SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def draws(doc_id: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the hex sha256 of `seed:doc_id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows with some _AT_ONCE bytes of text, at least one row each; nulls are empty and offsets are of 64 bits."""
    text = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    batch = batch.set_column(batch.schema.get_field_index(column), column, text)
    ends = np.cumsum(pc.binary_length(text).to_numpy())
    row = 0
    while row < len(ends):
        last = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + _AT_ONCE, "right")))
        yield batch.slice(row, last - row)
        row = last


def _joined(pieces: pa.Array, row: pa.Array, chosen: pa.Array, rows: int) -> pa.Array:
    """The chosen pieces of each row as one string."""
    ends = np.cumsum(np.bincount(pc.filter(row, chosen).to_numpy(), minlength=rows))
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int64()), pc.filter(pieces, chosen))
    return pc.binary_join(lists, pa.scalar("", pa.large_string()))


def _text(*parts) -> pa.Array:
    return pc.binary_join_element_wise(*(pa.scalar(p, pa.large_string()) if isinstance(p, str) else p for p in parts), pa.scalar("", pa.large_string()))


def transformed(text: pa.Array, h: list[np.ndarray], rate: int, spm_rate: int) -> dict[str, pa.Array]:
    """Columns n, form, prefix_chars, middle_chars and output of texts and their four draws."""
    rows = len(text)
    split = pc.split_pattern(text, "\n")
    count = pc.list_value_length(split).to_numpy()
    row = pc.list_parent_indices(split)
    piece = pc.list_flatten(split)
    first = np.cumsum(count) - count
    place = np.arange(len(piece)) - first[row.to_numpy()]
    last = pa.array(place == count[row.to_numpy()] - 1)
    unit = _text(piece, pc.if_else(last, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())))
    n = count - (pc.binary_length(piece).to_numpy()[first + count - 1] == 0)  # nothing after the last newline is no unit
    cuts = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)
    role = (place >= cuts[0][row.to_numpy()]).astype(np.int8) + (place >= cuts[1][row.to_numpy()])
    prefix, middle, suffix = (_joined(unit, row, pa.array(role == r), rows) for r in range(3))
    marked = pc.or_(pc.or_(pc.match_substring(text, PREFIX), pc.match_substring(text, SUFFIX)), pc.match_substring(text, MIDDLE))
    plain = pc.or_(pc.or_(marked, pc.equal(pc.binary_length(text), 0)), pa.array(h[2] % 100 >= rate))
    spm = pa.array(h[3] % 100 < spm_rate)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    moved = pc.if_else(spm, _text(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle), _text(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    none = pa.scalar(None, pa.int64())
    chars = [pc.if_else(plain, none, pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
    return {"n": pa.array(n, pa.int64()), "form": form, "prefix_chars": chars[0], "middle_chars": chars[1], "output": pc.if_else(plain, text, moved)}


def restored(form: pa.Array, output: pa.Array) -> pa.Array:
    """Texts from outputs and forms: the marks of a transformed text are the only ones in it."""
    spm = pc.equal(form, "spm")

    def parted(text: pa.Array, mark: str) -> tuple[pa.Array, pa.Array]:
        both = pc.split_pattern(text, mark, max_splits=1)
        tail = pc.list_slice(both, 1, 2)  # without the mark, nothing
        return pc.list_element(both, 0), pc.binary_join(tail, pa.scalar("", pa.large_string()))

    head, middle = parted(output, MIDDLE)
    front, back = parted(head, SUFFIX)  # psm: <P>prefix | suffix
    psm = _text(pc.utf8_slice_codeunits(front, len(PREFIX)), middle, back)
    front, back = parted(head, PREFIX)  # spm: <S>suffix | prefix
    other = _text(back, middle, pc.utf8_slice_codeunits(front, len(SUFFIX)))
    return pc.if_else(pc.equal(form, "plain"), output, pc.if_else(spm, other, psm))


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars (code points; null if plain), output; `rate` percent are transformed, `spm_rate` percent of these as spm."""

    def run(batches):
        for batch in batches:
            for part in _slices(batch, "text"):
                got = transformed(part.column("text"), [part.column(f"h{i}").to_numpy() for i in range(1, 5)], rate, spm_rate)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *got.values()], ["doc_id", *got])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *draws("doc_id", seed)).mapInArrow(lean(_plain_strings(run)), SCHEMA)


def restore(moved: DataFrame) -> DataFrame:
    """doc_id, text of rows (doc_id, form, output)."""

    def run(batches):
        for batch in batches:
            for part in _slices(batch, "output"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), restored(part.column("form"), part.column("output"))], ["doc_id", "text"])

    return moved.select("doc_id", "form", "output").mapInArrow(lean(_plain_strings(run)), "doc_id bigint, text string")


def _plain_strings(run):
    """Strings with offsets of 32 bits, as Spark takes them."""

    def inner(batches):
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays([c.cast(pa.string()) if c.type == pa.large_string() else c for c in batch.columns], batch.schema.names)

    return inner


def digests(moved: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, read back from output and form in the same pass."""

    def run(batches):
        import hashlib

        for batch in batches:
            for part in _slices(batch, "output"):
                text = restored(part.column("form"), part.column("output"))
                both = [pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column]) for column in (part.column("output"), text)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *both], [*kept, "output_sha256", "restored_sha256"])

    kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    return moved.select(*kept, "output").mapInArrow(lean(run), "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string")


ORACLE = r"""with h as (select doc_id, coalesce(text, '') as text, sha256('7:' || doc_id) as x, case when coalesce(text, '') = '' then [] else regexp_extract_all(text, '[^\n]*\n|[^\n]+') end as u from documents),
r as (select *, len(u)::bigint as n, ('0x' || substr(x, 1, 8))::bigint as h1, ('0x' || substr(x, 9, 8))::bigint as h2, ('0x' || substr(x, 17, 8))::bigint as h3, ('0x' || substr(x, 25, 8))::bigint as h4 from h),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from r),
p as (select *, array_to_string(u[1 : a], '') as pre, array_to_string(u[a + 1 : b], '') as mid, array_to_string(u[b + 1 :], '') as suf,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(text) as restored_sha256 from p"""
