"""The training-data operators' queries and SQL."""

from __future__ import annotations

from . import alignment, langid, linededup, mixing, mpegaudio, multiindex, packing, resampling, setsketch, simhash, surrogates, tokencounts, warc

_MODULES = (mpegaudio, multiindex, surrogates, tokencounts, warc, linededup, simhash, mixing, langid, packing, setsketch, alignment, resampling)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
