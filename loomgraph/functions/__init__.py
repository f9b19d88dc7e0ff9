"""The scalar functions of the engine in one place: Column to Column, built of Spark's own.

    from loomgraph import functions as L
    df.select(L.cosine("a", "b"), L.tokens("text"))
"""

import functools

from pyspark.sql import Column, functions as F

from ..operators import analytics, answers, chunk, fuse, lexical, predicates, records, router, routes, temporal, texts, vector
from ..sources import documents, readers

#: name -> function of Columns; column names may stand for Columns
SCALARS = {
    "tokens": lexical.tokens, "cosine": vector.cosine, "dot": vector.dot, "norm": vector.norm, "normalise": vector.normalise, "finite": vector.finite,
    "word_set": fuse.word_set, "jaccard": fuse.jaccard, "unit_score": fuse.unit, "combined_confidence": fuse.combined_confidence,
    "uuid5": chunk.uuid5, "local_name": texts.local_name, "classify": texts.classify, "json_array": texts.json_array, "memory_digest": texts.memory_digest, "cache_key": texts.cache_key, "embed_context": texts.embed_context,
    "iso_dates": temporal.iso_dates, "snippet": temporal.snippet, "date_confidence": router.date_confidence, "half_hour": analytics.half_hour,
    "dataset_of": predicates.dataset_of, "text_of": predicates.text_of, "cypher_allowed": predicates.cypher_allowed, "code_entity": predicates.code_entity, "not_sensitive": predicates.not_sensitive,
    "plain_name": routes.plain, "name_tokens": routes.name_tokens, "variants": answers.variants, "symbol": records.symbol, "bind": records.bind, "sign": records.sign, "coverage_guard": records.coverage_guard,
    "file_format": readers.file_format, "extraction_route": documents.extraction_route,
}


def _columns(f):
    @functools.wraps(f)
    def call(*args, **options) -> Column:
        return f(*[F.col(a) if isinstance(a, str) else a for a in args], **options)

    return call


globals().update({name: _columns(f) for name, f in SCALARS.items()})
__all__ = sorted(SCALARS)
