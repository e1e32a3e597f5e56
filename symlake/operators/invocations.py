"""Classified calls: routes, middleware, hosted services and registrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The calls that declare routes, with their verbs, and those that register services.
ROUTE_VERBS = {"MapGet": "GET", "MapPost": "POST", "MapPut": "PUT", "MapDelete": "DELETE", "MapPatch": "PATCH", "MapMethods": "ANY", "Map": "ANY"}
REGISTRATIONS = ("AddSingleton", "AddTransient", "AddScoped")
COLLECTION = "Microsoft.Extensions.DependencyInjection.IServiceCollection"
BUILDER = "Microsoft.AspNetCore.Builder.IApplicationBuilder"
APPLICATION = "Microsoft.AspNetCore.Builder.WebApplication"


def _is_or_implements(name: str) -> Column:
    return F.coalesce((F.col("receiver_type") == name) | F.array_contains("receiver_interfaces", name), F.lit(False))


def bucket() -> Column:
    """route, middleware, hosted, di, unclassified or null, by the first rule that applies."""
    name = F.col("method_name")
    builder = _is_or_implements(BUILDER) | F.coalesce(F.col("receiver_type") == APPLICATION, F.lit(False))
    collection = F.coalesce(F.col("reduced_first_param") == COLLECTION, F.lit(False)) | F.coalesce(F.col("containing_type").contains("ServiceCollection"), F.lit(False)) | _is_or_implements(COLLECTION)
    one_type = F.size(F.coalesce("type_args", F.array())) == 1
    return (
        F.when(name.isin(list(ROUTE_VERBS)), "route")
        .when(name.startswith("Use") & builder, "middleware")
        .when(name == "AddHostedService", F.when(one_type, "hosted"))
        .when(name.isin(list(REGISTRATIONS)), F.when(collection, "di"))
        .when(collection, "unclassified")
    )


def classify(invocations: DataFrame) -> DataFrame:
    """invocations with bucket, verb, template, handler, lifetime, service and implementation."""
    verbs = F.create_map(*[F.lit(x) for pair in ROUTE_VERBS.items() for x in pair])
    i = invocations.withColumn("bucket", bucket())
    on = lambda b, c: F.when(F.col("bucket") == b, c)
    return i.select(
        "*",
        on("route", verbs[F.col("method_name")]).alias("verb"),
        on("route", F.col("arg0_value")).alias("template"),
        on("route", F.get("arg_texts", F.lit(1))).alias("handler"),
        on("di", F.substring("method_name", 4, 100)).alias("lifetime"),
        on("di", F.get("type_args", F.lit(0))).alias("service"),
        on("di", F.get("type_args", F.lit(1))).alias("implementation"),
        on("hosted", F.get("type_args", F.lit(0))).alias("hosted_type"),
    )


def hosted_services(classified: DataFrame, subclasses: DataFrame) -> DataFrame:
    """(type, via): registered types, and subclasses of the background service that no call registers."""
    registered = classified.where("bucket = 'hosted'").select(F.col("hosted_type").alias("type")).distinct()
    rest = subclasses.select("type").distinct().join(registered, "type", "left_anti")
    return registered.withColumn("via", F.lit("registration")).union(rest.withColumn("via", F.lit("subclass")))


def lifetime_counts(classified: DataFrame) -> DataFrame:
    """lifetime (unclassified without one) and number of the registrations."""
    return classified.where(F.col("bucket").isin("di", "unclassified")).groupBy(F.coalesce("lifetime", F.lit("unclassified")).alias("lifetime")).agg(F.count("*").alias("n"))


def find_registrations(classified: DataFrame, query: str | None = None) -> DataFrame:
    """Registrations whose service, implementation or call contains query, whatever the case."""
    di = classified.where(F.col("bucket").isin("di", "unclassified"))
    if query is None:
        return di
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False))
    return di.where(F.when(F.col("bucket") == "di", has("service") | has("implementation") | has("raw_call")).otherwise(has("raw_call")))


def with_consumers(registrations: DataFrame, parameters: DataFrame) -> DataFrame:
    """registrations with the number of types that take the service as a parameter.

    parameters: key (type), containing_type.
    """
    n = parameters.select("key", "containing_type").distinct().groupBy("key").agg(F.count("*").alias("consumers"))
    return registrations.join(n, registrations["service"] == n["key"], "left").drop("key").fillna(0, ["consumers"])
