"""Choosing a search strategy for each query, by signals in its text and the backends there are."""

import re

from pyspark.sql import Column, DataFrame, functions as F

#: what a deployment may have
CAPABILITIES = ("embedding", "bm25", "graph", "llm", "sql", "cypher", "communities")

# fixed values: words and patterns that signal a strategy
CYPHER = r"^(match |match\(|return |optional match |with |unwind )"
CODE = r"\w+\(|\w+\.\w+\(|\w+::\w+|\w+->\w+|(func|fn|def|class|import|package|module|struct|interface|impl)\s"
SNAKE = r"[a-z]+_[a-z]+_[a-z]+"
RELATIONAL = (
    "related to", "relationship", "connected to", "linked to", "depends on", "dependency", "calls ", "imports ", "inherits", "extends", "implements",
    "связан с", "связь", "отношени", "зависит от", "зависимость", "вызывает", "импортирует", "наследует", "расширяет", "реализует",
)
SUMMARY = (
    "summary", "summarize", "summarise", "overview", "digest", "recap", "brief", "outline", "highlights",
    "итог", "итого", "резюме", "обзор", "краткое", "краткий", "подвед", "суммар", "пересказ",
)
QUESTION = (
    "кто ", "что ", "когда ", "где ", "как ", "почему ", "зачем ", "какой ", "какая ", "какие ", "каким ", "сколько ", "чем ", "откуда ", "куда ",
    "who ", "what ", "when ", "where ", "how ", "why ", "which ", "whose ", "whom ", "is ", "are ", "was ", "were ", "do ", "does ", "did ",
    "can ", "could ", "will ", "would ", "should ", "tell me ", "explain ", "describe ",
)


def _contains(text: Column, words) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def date_confidence(text: Column) -> Column:
    """The surest kind of date in a text: ISO 1, month name .9, slashed or dotted .8, bare year .7; null without any."""
    from .temporal import MONTHS

    names = "|".join(n for v in MONTHS.values() for n in v)
    low = F.lower(text)
    return (
        F.when(text.rlike(r"\d{4}-\d{2}-\d{2}"), 1.0)
        .when(low.rlike(rf"\d{{1,4}}\s+({names})|({names})[a-zа-яё]*\.?(\s+\d{{1,4}}|,\s+\d{{4}})"), 0.9)
        .when(text.rlike(r"\d{1,2}[./]\d{1,2}[./]\d{4}|\d{4}[./]\d{1,2}[./]\d{1,2}"), 0.8)
        .when(text.rlike(r"(^|[\s(,])(1\d{3}|20\d{2}|2100)($|[\s),.])"), 0.7)
    )


def candidates(text: Column, have) -> list:
    """[(condition, strategy, score, reason)] in the order in which ties are settled."""
    q = F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))
    low = F.lower(q)
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    has = lambda *names: F.lit(all(n in have for n in names))
    graph = F.lit("graph" in have or "sql" in have)
    camel = F.exists(F.split(q, r"\s+"), lambda w: w.rlike("[a-z][A-Z]") & (F.octet_length(w) >= 4))
    relational, summary = _contains(low, RELATIONAL), _contains(low, SUMMARY)
    question = F.contains(low, F.lit("?")) | F.exists(F.array(*map(F.lit, QUESTION)), lambda w: F.startswith(low, w))
    keyword = F.size(words).between(1, 3) & ~F.exists(words, lambda w: w.rlike(r"[^\p{L}\p{Nd}_-]"))
    sure = date_confidence(q)
    return [
        (low.rlike(CYPHER) & has("cypher", "graph"), "CYPHER", F.lit(1.0), "a graph query"),
        (sure.isNotNull() & graph, "TEMPORAL", 0.85 + sure * 0.1, "names a date"),
        ((q.rlike(CODE) | camel | q.rlike(SNAKE)) & graph, "CODING_RULES", F.lit(0.85), "has code in it"),
        (relational & has("llm") & graph, "GRAPH_COMPLETION", F.lit(0.8), "asks for relations"),
        (summary & has("embedding"), "SUMMARIES", F.lit(0.85), "asks for a summary"),
        (summary & has("communities", "llm", "embedding"), "COMMUNITY_GLOBAL", F.lit(0.88), "asks for an overview, communities are summed up"),
        (relational & has("communities", "llm", "embedding"), "COMMUNITY_LOCAL", F.lit(0.82), "asks for relations, communities are known"),
        (question & has("llm", "embedding"), "RAG_COMPLETION", F.lit(0.7), "a question"),
        (keyword & has("bm25", "embedding"), "HYBRID", F.lit(0.75), "a few keywords"),
        (keyword & has("bm25") & ~has("embedding"), "CHUNKS_LEXICAL", F.lit(0.7), "a few keywords, no embeddings"),
        (has("bm25", "embedding"), "HYBRID", F.lit(0.6), "default"),
        (has("embedding"), "CHUNKS", F.lit(0.5), "vectors"),
        (has("bm25"), "CHUNKS_LEXICAL", F.lit(0.4), "keywords"),
    ]


def route(rows: DataFrame, have=CAPABILITIES, text: str = "text", weights: dict | None = None) -> DataFrame:
    """``rows`` with strategy, confidence, reason and alternatives [(strategy, score)].

    The highest score wins, the first on a tie.  ``weights`` multiplies strategies' scores by what
    feedback has taught.  The empty text takes the default at .3; without any backend it is CHUNKS at .1.
    """
    weight = lambda name: float((weights or {}).get(name, 1.0))
    found = F.array(*[F.when(c, F.struct(F.lit(n).alias("strategy"), F.round(s * weight(n), 6).alias("score"), F.lit(r).alias("reason"))) for c, n, s, r in candidates(F.col(text), have)])
    default = "HYBRID" if {"bm25", "embedding"} <= set(have) else "CHUNKS" if "embedding" in have else "CHUNKS_LEXICAL" if "bm25" in have else None
    found = F.filter(found, lambda x: x.isNotNull())
    out = rows.withColumn("_found", found).withColumn("_best", F.reduce("_found", F.get("_found", F.lit(0)), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a)))
    empty, none = F.col(text) == "", F.size("_found") == 0
    fixed = lambda value, e, n: F.when(empty, F.lit(e if default else n)).when(none, F.lit(n)).otherwise(value)
    # each other strategy once, with its first score
    names = F.array_distinct(F.transform("_found", lambda x: x["strategy"]))
    others = F.transform(F.filter(names, lambda s: s != F.col("_best.strategy")), lambda s: F.filter("_found", lambda x: x["strategy"] == s).getItem(0))
    return out.withColumns({
        "strategy": fixed(F.col("_best.strategy"), default, "CHUNKS"), "confidence": fixed(F.col("_best.score"), 0.3, 0.1), "reason": fixed(F.col("_best.reason"), "empty", "no backend"),
        "alternatives": F.when(empty | none, F.array().cast("array<struct<strategy:string,score:double>>")).otherwise(F.transform(others, lambda x: F.struct(x["strategy"].alias("strategy"), x["score"].alias("score")))),
    }).drop("_found", "_best")


# fixed values: what joins two questions, and what begins one
CONJUNCTIONS = (" и ", " а также ", " and ", " or ", ", а ", ", и ")
QUESTIONS = ("what", "how", "why", "who", "where", "when", "which", "что", "как", "почему", "кто", "где", "когда")


def decompose(query: str):
    """The query and its parts: at the first conjunction once, both halves five bytes or more; else at its questions."""
    for c in CONJUNCTIONS:
        if c in query:
            a, b = (x.strip() for x in query.split(c, 1))
            if len(a.encode()) >= 5 and len(b.encode()) >= 5:
                return list(dict.fromkeys([query, a, b]))
            break
    low = query.lower()
    if len({q for q in QUESTIONS if re.search(rf"\b{q}\b", low)}) >= 2:
        parts = [p.strip(" ?,") for p in re.split(rf"\?|(?=\b(?:{'|'.join(QUESTIONS)})\b)", query, flags=re.IGNORECASE)]
        return list(dict.fromkeys([query, *[p for p in parts if len(p.encode()) >= 5]]))
    return [query]
