"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import functools
import gc
import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivalry.session import cut_lineage, scratch_path, ship_package, small_batches, table

__all__ = ["cut_lineage", "scratch_path", "ship_package", "table", "let", "WORD", "BLANK", "keyed_id",
           "tokenizer_path", "small_batches", "kept"]

#: The contract's word: a maximal run of anything but space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"

_LET = itertools.count()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A higher-order lambda evaluates a captured *expression* for every element;
    binding it to a lambda variable of a one-element ``transform`` does not.
    """
    return F.transform(F.array(value), body)[0]


def keyed_id(name: str) -> Column:
    return F.col(name).cast("long")


def tokenizer_path(name_or_path: str) -> str:
    """A vocabulary file: a path as given, or a bare name of the public
    tokenizer files, resolved on the machine that opens it."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers
    return public_tokenizers.path(name_or_path)


class ChunkTable(dict):
    """Values of distinct text chunks, computed once and kept up to ``room`` entries.

    ``compute(list_of_chunks) -> list_of_values`` is called once per batch with
    the distinct chunks that are not kept yet.  When the table is full, further
    chunks are still computed (once per batch), just not kept: memory is
    bounded and no chunk is dropped.  Chunks longer than ``longest`` are never kept.
    """

    def __init__(self, compute, room: int = 400_000, longest: int = 48):
        super().__init__()
        self.compute, self.room, self.longest, self.passing = compute, room, longest, {}

    def __missing__(self, chunk):
        return self.passing[chunk]

    def prepare(self, chunk_lists) -> None:
        """Makes ``table[chunk]`` work for every chunk of the lists until the next call."""
        missing = list(itertools.filterfalse(self.__contains__, set().union(*chunk_lists)))
        self.passing = {}
        if missing:
            found = dict(zip(missing, self.compute(missing), strict=True))
            free = max(0, self.room - len(self))
            keep = [c for c in missing if len(c) <= self.longest][:free]
            for c in keep:
                self[c] = found.pop(c)
            self.passing = found


@functools.lru_cache(maxsize=4)
def bpe_tokenizer(path: str):
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


_KEPT: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """What this Python worker keeps for ``operator`` from one task to the next.

    Spark goes on with the same workers in later operators.  A worker that begins
    another one drops what it kept, so a table of hundreds of MB does not stay
    beside the memory of steps that have no use for it.
    """
    if operator not in _KEPT:
        _KEPT.clear()
        bpe_tokenizer.cache_clear()
        gc.collect()  # a table and the function that fills it refer to each other
        pa.default_memory_pool().release_unused()
        _KEPT[operator] = {}
    return _KEPT[operator]


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra columns with any name never clash."""
    return df.select(*[F.col(n) for n in names])
