"""Masking policies by role.

A policy table has columns name, default_action and rules: array<struct<entity_types: array<string>, action:
string, condition: struct<field: string, operator: string, value: string>>>. Bindings: api_key, role, policy.
Both are configuration, of at most some thousand rows, which is checked before they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ROWS = 10_000
CONDITION = "struct<field:string,operator:string,value:string>"
RULES = f"array<struct<entity_types:array<string>,action:string,condition:{CONDITION}>>"
POLICIES = f"name string, description string, default_action string, rules {RULES}"
BINDINGS = "api_key string, role string, policy string"


def parse_policies(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(policies, bindings) of a JSON document with `policies` and `role_bindings`."""
    return _read(spark.createDataFrame([(text,)], "value string"))


def load_policies(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """parse_policies of a file in any store that Spark reads."""
    return _read(spark.read.text(path, wholetext=True))


def _read(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    schema = f"policies array<struct<name:string,description:string,default_action:string,rules:{RULES}>>, role_bindings array<struct<api_key:string,role:string,policy:string>>"
    read = raw.select(F.from_json("value", schema).alias("d")).select("d.*")
    policies = read.select(F.explode("policies").alias("p")).select("p.*").withColumn("default_action", F.coalesce("default_action", F.lit("mask")))
    return policies, read.select(F.explode("role_bindings").alias("b")).select("b.*")


def with_policy(policies: DataFrame, name: str, default_action: str = "mask", rules: list[dict] = ()) -> DataFrame:
    """`policies` with one more; a policy of the same name is replaced."""
    rows = [(name, "", default_action, [(r["entity_types"], r.get("action", "mask"), None if not r.get("condition") else (r["condition"]["field"], r["condition"]["operator"], str(r["condition"]["value"]))) for r in rules])]
    return policies.filter(F.col("name") != name).unionByName(policies.sparkSession.createDataFrame(rows, POLICIES), allowMissingColumns=True)


def with_binding(bindings: DataFrame, api_key: str, role: str, policy: str) -> DataFrame:
    return bindings.filter(F.col("api_key") != api_key).unionByName(bindings.sparkSession.createDataFrame([(api_key, role, policy)], BINDINGS))


def _small(df: DataFrame) -> DataFrame:
    """A broadcast hint for configuration of a checked size; without it Spark plans a shuffle join."""
    return F.broadcast(df) if df.limit(MOST_ROWS + 1).count() <= MOST_ROWS else df


def policy_for_key(df: DataFrame, bindings: DataFrame, policies: DataFrame, key_col: str = "api_key") -> DataFrame:
    """`df` with role and policy (a struct). Without a binding, or with an unknown policy: mask everything."""
    bound = df.join(_small(bindings.select(F.col("api_key").alias(key_col), "role", F.col("policy").alias("_policy"))), key_col, "left")
    named = bound.join(_small(policies.select(F.col("name").alias("_policy"), F.struct("name", "default_action", "rules").alias("policy"))), "_policy", "left")
    default = F.struct(F.lit("default").alias("name"), F.lit("mask").alias("default_action"), F.array().cast(RULES).alias("rules"))
    return named.withColumn("policy", F.coalesce("policy", default)).drop("_policy")


def rule_matches(rule: Column, entity_type: Column) -> Column:
    return F.array_contains(rule["entity_types"], "*") | F.array_contains(F.transform(rule["entity_types"], lambda t: F.upper(t)), F.upper(entity_type))


def condition_holds(condition: Column, value: Column) -> Column:
    """Conditions on value_length, numeric_value and pattern; unknown fields and operators hold."""
    figures = F.regexp_replace(value, r"[^0-9.]", "")
    number = F.when(figures == "", F.lit(0.0)).otherwise(figures.try_cast("double"))
    actual = F.when(condition["field"] == "value_length", F.length(value).cast("double")).when(condition["field"] == "numeric_value", number)
    target, op = condition["value"].try_cast("double"), condition["operator"]
    compared = F.when(op == "gt", actual > target).when(op == "lt", actual < target).when(op == "eq", actual == target).when(op == "gte", actual >= target).when(op == "lte", actual <= target)
    matched = F.when((condition["field"] == "pattern") & (op == "matches"), F.regexp_like(value, F.concat(F.lit("(?i)"), condition["value"])))
    return F.when(condition.isNull(), True).when(condition["field"] == "pattern", F.coalesce(matched, F.lit(True))).otherwise(F.coalesce(compared, F.lit(True)))


def action(policy: Column, entity_type: Column, value: Column) -> Column:
    """The action of the first rule that matches and whose condition holds, else the default."""
    first = F.filter(policy["rules"], lambda r: rule_matches(r, entity_type) & condition_holds(r["condition"], value))
    return F.coalesce(F.get(first, F.lit(0))["action"], policy["default_action"])


def apply_policy(spans: Column, policy: Column) -> Column:
    """Spans to mask or to redact (their types led by REDACTED_); passed ones go. Comes after overlaps are resolved."""
    marked = F.transform(spans, lambda s: F.struct(s.alias("s"), action(policy, s["entity_type"], s["text"]).alias("a")))
    kept = F.filter(marked, lambda x: x["a"] != "pass")
    return F.transform(kept, lambda x: F.when(x["a"] == "redact", x["s"].withField("entity_type", F.concat(F.lit("REDACTED_"), x["s"]["entity_type"]))).otherwise(x["s"]))


def masked_views(df: DataFrame, roles: DataFrame, policies: DataFrame, session_col: str = "session_id", text_col: str = "text") -> DataFrame:
    """A masked text for each row of `df` (with spans) and each of the roles (columns role, policy): P rows per text."""
    from pallium.operators.mask import mask

    if roles.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} roles")
    few = roles.join(policies.select(F.col("name").alias("policy"), "default_action", "rules"), "policy", "left")
    default = F.struct(F.lit("default").alias("name"), F.lit("mask").alias("default_action"), F.array().cast(RULES).alias("rules"))
    listed = few.agg(F.collect_list(F.struct("role", F.when(F.col("rules").isNotNull(), F.struct(F.col("policy").alias("name"), "default_action", "rules")).otherwise(default).alias("policy"))).alias("views"))
    each = df.join(F.broadcast(listed)).withColumn("v", F.explode("views")).withColumns({"role": F.col("v.role"), "spans": apply_policy(F.col("spans"), F.col("v.policy"))})
    return mask(each, text_col, session_col).drop("v", "views")
