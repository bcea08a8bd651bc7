"""Query analysis: token weights, token filter and the plan of must and should clauses."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the service: single characters that never search alone, the most tokens of a
# query, and the factors of parts of speech (any other counts 1).
BANNED = "学机"
MOST_TOKENS = 6
POS_FACTORS = {"n": 2.0, "ns": 2.0, "nt": 2.0, "nz": 2.0, "nl": 2.0, "ng": 2.0, "m": 2.0, "t": 2.0, "x": 0.5, "v": 1.2, "c": 1.0}


@dataclass
class QueryPlan:
    must: list[str] = field(default_factory=list)
    should: list[str] = field(default_factory=list)
    must_not: list[str] = field(default_factory=list)
    must_p: int = 0
    should_p: int = 0
    weights: dict[str, float] = field(default_factory=dict)

    def clauses(self) -> list[tuple[str, float, str]]:
        """(token, weight, clause); a token that is both must and should is must."""
        out = [(t, self.weights.get(t, 1.0), "must") for t in self.must]
        out += [(t, self.weights.get(t, 1.0), "should") for t in self.should if t not in self.must]
        return out + [(t, self.weights.get(t, 1.0), "must_not") for t in self.must_not]


def _split(tokens: list[str], query: str) -> tuple[list[str], list[str], int]:
    """Must, should and the least number of should for tokens by falling weight."""
    n = len(tokens)
    if n == 0:
        return [], [], 0
    if n == 1:
        return [], tokens, 1
    if n == 2:
        a, b = tokens
        if len(a) == 1 and len(b) == 1:
            return [], [b, a], 1
        if a in b or b in a:
            return ([b], [a], 0) if len(b) > 1 else ([a], [b], 0)
        return [a], [b], 0
    if n == 3:
        a, b, c = tokens
        if a == query and b in a and c in a:
            core = b
        elif b not in a and c not in a and c not in b:
            core = a
        else:
            core = c if c in a else a
    else:
        core = tokens[1] if tokens[0] == query else tokens[0]
    rest = [t for t in tokens if t != core]
    return [core], rest, len(rest) // 4 + 1 if n >= 4 and len(rest) > 4 else 0


def plan_query(query: str, weights: dict[str, float], strictness: int = 6) -> QueryPlan:
    """The plan for a query and its weighted tokens.

    ``strictness`` of ten or more searches the whole query alone.  A plus sign
    that is not doubled makes every token optional.  The whole query is always
    one of the optional clauses.
    """
    if not query:
        return QueryPlan()
    if strictness >= 10:
        return QueryPlan(should=[query], should_p=1, weights={query: 1.0})
    tokens = sorted(weights, key=lambda t: (-weights[t], t))
    must, should, least = ([], tokens, 1) if "+" in query and "++" not in query else _split(tokens, query)
    should = should + [query] * (query not in should)
    return QueryPlan(must, should, [], int(bool(must)), least, {**{query: 1.0}, **weights})


def relaxed(plan: QueryPlan) -> QueryPlan:
    """The second search: nothing is required, every token is optional, the threshold stays."""
    should = plan.should + [t for t in plan.must if t not in plan.should]
    return QueryPlan([], should, plan.must_not, 0, plan.should_p, plan.weights)


def length_factor(token: Column) -> Column:
    return F.when(F.length(token) == 1, F.lit(1.0)).otherwise(3.0 * F.length(token))


def keyword_factor(w: Column) -> Column:
    return F.when(w <= 5, F.pow(F.lit(2.0), w)).otherwise(32.0 + 2.0 * (w - 5))


def rule_factor(token: Column) -> Column:
    """Tokens about learning count more, names of schools less."""
    return F.when(token.rlike("大学|中学|小学"), 0.8).when(F.instr(token, "学") > 0, 1.1).otherwise(1.0)


def token_weights(tokens: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """query_id, query, token, freq, weight from query_id, query, token (a row for each occurrence).

    ``factors`` (token, keyword, pos) gives keyword weights and part-of-speech
    factors; without it, or for tokens it lacks, they are neutral.
    """
    rows = tokens.groupBy("query_id", "query", "token").agg(F.count("*").alias("freq"))
    weight = F.col("freq") * length_factor(F.col("token")) * rule_factor(F.col("token"))
    if factors is not None:
        rows = rows.join(factors, "token", "left")
        weight = weight * F.coalesce(keyword_factor(F.col("keyword")), F.lit(1.0)) * F.coalesce("pos", F.lit(1.0))
    return rows.select("query_id", "query", "token", "freq", weight.alias("weight"))


def tie_break(weights: DataFrame) -> DataFrame:
    """Of tokens of equal weight, one that splits its query in two gains by the length before it."""
    tied = F.count("*").over(Window.partitionBy("query_id", "weight")) > 1
    first = F.instr("query", F.col("token"))
    once = (first > 0) & (F.length(F.replace("query", F.col("token"), F.lit(""))) == F.length("query") - F.length("token"))
    bonus = (F.lit(1.0) * (first - 1) + 0.5 * F.length("token")) * 0.1
    return weights.withColumn("weight", F.col("weight") + F.when(tied & once, bonus).otherwise(0.0))


def core_word(weights: DataFrame, cores: DataFrame) -> DataFrame:
    """A listed core word weighs as much as all tokens of its query together."""
    total = F.sum("weight").over(Window.partitionBy("query_id"))
    marked = weights.join(F.broadcast(cores.select("token", F.lit(True).alias("core")).distinct()), "token", "left") if cores is not None else weights
    return marked.withColumn("weight", F.when(F.col("core"), total).otherwise(F.col("weight"))).drop("core")


def keep_tokens(weights: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    """Without banned single characters and integers if there are several tokens, the heaviest few."""
    several = F.count("*").over(Window.partitionBy("query_id")) >= 2
    banned = F.instr(F.lit(BANNED), F.col("token")) > 0
    rows = weights.withColumn("_several", several).where(~F.col("_several") | ~((F.length("token") == 1) & banned | F.col("token").rlike(r"^\d+$"))).drop("_several")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "token"))
    return rows.withColumn("place", place).where(F.col("place") <= most)
