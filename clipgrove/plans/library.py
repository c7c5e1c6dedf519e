"""The library page: catalog, overlay, edit marks, search, facets, one page."""

from __future__ import annotations

from pyspark.sql import DataFrame

from clipgrove.operators import catalog as C


def library_clips(clips: DataFrame, meta: DataFrame, edited: DataFrame, key: str = "path") -> DataFrame:
    return C.mark_edited(C.overlay(clips, meta, key), edited, key)


def library_page(
    library: DataFrame, query: str = "", edited: bool = False, sources: list[str] | None = None,
    offset: int = 0, limit: int | None = 100, oldest: bool = False,
) -> DataFrame:
    found = C.facet_filter(C.search(library, query), edited, sources)
    return C.page(found, offset, limit, oldest)
