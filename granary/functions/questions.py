"""Rules that type a question and score chunks for it, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions import text as X

#: Patterns of each question type, in order of preference. Fixed values.
TYPES: dict[str, list[str]] = {
    "HYPERPARAMETERS": [
        r"\b(hyperparameter|parameter|setting|config|learning rate|batch size|dropout|gamma|alpha|beta|epsilon|lambda|momentum|weight decay)\b",
        r"\b(what is the|what are the|how much|how many|what value|what size)\b.*\b(discount|buffer|window|layer|hidden|embedding)\b",
        r"\b(set to|initialized to)\b",
    ],
    "DATASETS": [r"\b(dataset|data|training data|test data|evaluation data|corpus)\b", r"\b(common crawl|webtext|mnist|cifar|imagenet)\b"],
    "EQUATIONS": [r"\b(equation|formula|mathematical|objective function|loss function)\b", r"\b(kl divergence|cross entropy|gradient|derivative)\b"],
    "TABLES": [r"\b(table|tabular|row|column)\b"],
    "FIGURES": [r"\b(figure|plot|graph|chart|visualization)\b"],
    "ALGORITHMS": [r"\b(algorithm|method|approach|technique|procedure)\b", r"\b(cma-es|sgd|adam|rmsprop|adamw)\b"],
    "TRAINING": [r"\b(train|training|learn|learning|optimization|optimize)\b", r"\b(epoch|iteration|step|update)\b"],
    "RESULTS": [r"\b(result|performance|accuracy|score|metric|benchmark)\b", r"\b(super|glue|sota|state of the art)\b"],
    "LIMITATIONS": [r"\b(limitation|weakness|drawback|issue|problem|fail)\b", r"\b(not able|cannot|unable|struggle)\b"],
}
#: Chunk types preferred for each question type. Fixed values.
PREFERRED: dict[str, list[str]] = {
    "HYPERPARAMETERS": ["HYPERPARAMETERS", "TABLE", "MIXED", "TEXT"], "DATASETS": ["TABLE", "TEXT", "MIXED"], "EQUATIONS": ["EQUATION", "TEXT", "MIXED"], "TABLES": ["TABLE", "TEXT"], "FIGURES": ["TEXT"],
    "ALGORITHMS": ["ALGORITHM", "TEXT", "MIXED"], "TRAINING": ["ALGORITHM", "TEXT", "MIXED"], "RESULTS": ["TABLE", "TEXT", "MIXED"], "LIMITATIONS": ["TEXT"],
    "GENERAL": ["TEXT", "MIXED", "TABLE", "EQUATION", "HYPERPARAMETERS", "ALGORITHM"],
}
#: Patterns of each kind of handler a question may go to. Fixed values.
ROUTES: dict[str, list[str]] = {
    "code": ["function", "class", "method", "import", "def", "implements?", "code", "syntax", "source", "api", "module", "package", "interface", "refactor", "bug", "debug", "fix", "loop", "recursion", "call", "inherit", "pattern", "architecture", "instantiat", "signature", "docstring", "decorator"],
    "data": ["how many", "count", "sum", "average", "number of", "percentage", "statistic", "frequency", "distribution", "max", "min", "extract", "list all", "enumerate", "what values?", "compare", "which files?", "how often", "metric", "measure"],
    "reasoning": ["why", "explain", "how does", "what is", "understand", "difference between", "pros and cons", "purpose", "design decision", "trade.?off", "analyze", "evaluate", "infer", "deduce", "strategy", "approach", "advantage"],
}

#: Words that ask about several papers at once. Fixed values.
COMPARISONS = ["compare", "vs", "versus", "difference between", "different", "contrast", "both", "all", "each", "multiple", "several"]
#: Words of kinds of question, the first that is held counts; intents with the words before a symbol. Fixed values.
KINDS = [("table|figure|chart", "Table"), ("equation|formula|mathematical", "Equation"), ("how many|what is the|number|count|percentage", "Numerical"), ("compare|difference|versus|vs", "Comparison"), ("why|how|explain|describe", "Reasoning")]
INTENTS = {"definition": "where is(?: the)?", "callers": "(?:who|what) calls", "imports": "(?:who|what) imports", "comparison": "compare", "explanation": "explain how the"}


def type_counts(question: Column) -> dict[str, Column]:
    """The number of pattern matches of each question type."""
    q = F.lower(question)
    return {t: sum((F.regexp_count(q, F.lit(p)) for p in ps[1:]), F.regexp_count(q, F.lit(ps[0]))) for t, ps in TYPES.items()}


def question_type(question: Column) -> Column:
    """(type, confidence): the type of most matches, earlier ones first; GENERAL at 0.5 without any."""
    counts = type_counts(question)
    most = F.greatest(*counts.values())
    kind = F.coalesce(*[F.when((c == most) & (c > 0), F.lit(t)) for t, c in counts.items()], F.lit("GENERAL"))
    return F.struct(kind.alias("type"), F.when(most > 0, F.least(most / 3, F.lit(1.0))).otherwise(0.5).alias("confidence"))


def route(question: Column) -> Column:
    """(agent, confidence): the handler with the largest share of matching patterns, ties in the order given, and its part of all shares.

    A handler of under 0.6 gives way to ``reasoning``; ``code`` at 0.75 or more is final.
    """
    q = F.lower(question)
    shares = {a: sum((q.rlike(rf"\b{p}\b").cast("int") for p in ps[1:]), q.rlike(rf"\b{ps[0]}\b").cast("int")) / len(ps) for a, ps in ROUTES.items()}
    most = F.greatest(*shares.values())
    every = sum(list(shares.values())[1:], next(iter(shares.values())))
    sure = F.when(every > 0, most / every).otherwise(0.0)
    best = F.coalesce(*[F.when(s == most, F.lit(a)) for a, s in shares.items()])
    agent = F.when((best == "code") & (sure >= 0.75), best).when(sure < 0.6, "reasoning").otherwise(best)
    return F.struct(agent.alias("agent"), F.round(sure, 6).alias("confidence"))


def type_score(kind: Column, chunk: Column, content: Column) -> Column:
    """How well a chunk suits a question type: its place among the preferred types, with bonuses for numbers and settings."""
    place = F.lit(None).cast("double")
    for t, types in PREFERRED.items():
        at = F.array_position(F.array(*map(F.lit, types)), chunk)
        place = F.when(kind == t, F.when(at > 0, (len(types) - at + 1) / len(types)).otherwise(0.5)).otherwise(place)
    text = F.lower(content)
    numbers = F.least(F.regexp_count(text, F.lit(X.NUMBER)) * 0.1, F.lit(0.8))
    pairs = F.least(F.regexp_count(text, F.lit(r"[a-zA-Z_][a-zA-Z0-9_]*\s*[=:]\s*[-+]?[0-9]*\.?[0-9]+")) * 0.2, F.lit(1.0))
    bonus = F.when(kind.isin("HYPERPARAMETERS", "RESULTS", "TRAINING"), numbers).otherwise(0.0) + F.when(kind == "HYPERPARAMETERS", pairs).otherwise(0.0)
    return place + bonus
