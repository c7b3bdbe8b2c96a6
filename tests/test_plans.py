"""What the physical plans must and must not hold."""

import pytest
from pyspark.sql import functions as F

from warnloom.operators import cvss, entities, indicators, narrative, similarity
from warnloom.operators.joins import lookup_join
from warnloom.plans.analyze import analyze_reports, spread_input
from warnloom.sources.staging import stage


@pytest.fixture(scope="module")
def stored(spark):
    rows = spark.range(200).select(
        F.col("id").alias("report_id"),
        F.concat(F.lit("r"), "id").alias("filename"),
        F.lit("ransomware CVE-2024-1000 on 2024-01-01 at 1.2.3.4. Emotet seen here.").alias("text"),
        F.lit("unused").alias("other"),
    )
    return stage(rows, "stored")


@pytest.fixture(scope="module")
def dimension(spark):
    return spark.createDataFrame(
        [("CVE-2024-1000", 9.8, "CRITICAL", "AV", "v31")],
        "cve_id STRING, score DOUBLE, severity STRING, vector STRING, version STRING",
    )


def nodes_of(df):
    """(name, text) of each node of the physical plan, top down, subqueries left out."""
    found = []

    def walk(node):
        found.append((node.nodeName(), node.simpleString(10_000)))
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().sparkPlan())
    return found


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()



def test_analysis_has_no_shuffle(stored, dimension):
    nodes = [name for name, _ in nodes_of(analyze_reports(stored, dimension))]
    assert not [n for n in nodes if "Exchange" in n or "Join" in n or "Aggregate" in n or "Generate" in n], nodes
    assert [n for n in nodes if n.startswith("Scan parquet")]


def test_the_text_is_gone_before_the_lookup(stored, dimension):
    out = analyze_reports(stored, dimension)
    names = [name for name, _ in nodes_of(out)]
    assert names.count("ArrowEvalPython") == 1
    rest = nodes_of(out)[names.index("ArrowEvalPython") + 1 :]
    assert rest[0][0] == "CollectMetrics"
    _, below = rest[1]
    produced = below[below.index("[") :].split(" AS ")
    assert below.startswith("Project") and not [c for c in produced if c.startswith("text#")]


def test_only_needed_columns_are_read_and_computed(stored, dimension):
    out = analyze_reports(stored, dimension).groupBy("threat_type").count()
    plan = plan_of(out)
    schema = plan[plan.index("ReadSchema") :].split(">")[0]
    assert "text" in schema and "other" not in schema and "filename" not in schema
    assert "regexp_extract_all" not in plan  # no indicator, date or name search for a count by type


def test_filters_on_results_stay_above_the_analysis(stored, dimension):
    out = analyze_reports(stored, dimension).filter("severity = 'Critical'")
    names = [name for name, _ in nodes_of(out)]
    assert names.count("Filter") == 1 and names.index("Filter") < names.index("CollectMetrics")
    assert out.count() == 200


def test_filters_on_input_columns_reach_the_scan(stored, dimension):
    plan = plan_of(analyze_reports(stored.filter("report_id < 5"), dimension))
    assert "PushedFilters: [IsNotNull(report_id), LessThan(report_id,5)]" in plan


@pytest.mark.parametrize(
    "make",
    [
        lambda df: indicators.iocs_long(indicators.extract_iocs(df)),
        lambda df: narrative.date_mentions(df),
        lambda df: narrative.score_sentences(df),
        lambda df: entities.name_mentions(df),
        lambda df: similarity.tokenize_terms(df),
    ],
)
def test_long_forms_compute_each_array_once(stored, make):
    plan = plan_of(make(stored))
    assert "Exchange" not in plan
    below_scan_filters = [line for line in plan.split("\n") if "Filter" in line and "regexp" in line]
    assert not below_scan_filters


def test_similarity_shuffles_reports_not_terms(stored):
    history = stored.select(
        "report_id", "filename", F.lit("DDoS").alias("threat_type"), F.lit("Low").alias("severity"),
        F.concat_ws(" ", "text", "text", "text").alias("text_excerpt"),
    )
    plan = plan_of(similarity.find_similar_incidents("ransomware at emotet", history))
    shuffles = [line for line in plan.split("\n") if "Exchange hashpartitioning(report_id" in line]
    assert shuffles and all("term" not in line for line in shuffles)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "TakeOrderedAndProject" in plan


def test_lookup_join_spreads_a_hot_key(spark):
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"))
    lookup = spark.createDataFrame([("hot", 1), ("1", 2), ("none", 3)], "key STRING, value INT")
    small = lookup_join(big, lookup, ["key"], spread_by=["id"])
    assert "BroadcastHashJoin" in plan_of(small)
    salted = lookup_join(big, lookup, ["key"], spread_by=["id"], broadcast_rows=0, salts=8)
    assert "_salt" in plan_of(salted)
    assert sorted(map(tuple, salted.collect()), key=str) == sorted(map(tuple, small.collect()), key=str)
    assert salted.count() == 3000 and salted.filter("value = 1").count() == 1000


def test_an_analysis_can_meet_itself(stored, dimension):
    once = analyze_reports(stored.filter("report_id < 20"), dimension)
    assert once.union(once).count() == 40
    critical = once.filter("severity = 'Critical'").select("report_id")
    assert once.join(critical, "report_id", "left_semi").count() == 20
    assert once.alias("a").join(once.alias("b"), F.col("a.report_id") == F.col("b.report_id")).count() == 20


def test_small_inputs_are_spread_and_large_ones_left_alone(spark, stored):
    cores = spark.sparkContext.defaultParallelism
    assert spread_input(stored.coalesce(1)).rdd.getNumPartitions() == cores
    many = stored.repartition(cores + 1)
    assert spread_input(many) is many


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_a_lookup_table_beyond_the_bound_is_never_broadcast(spark, how):
    big = spark.range(1000).select(F.col("id"), (F.col("id") % 40).alias("key"))
    lookup = stage(spark.range(30).select(F.col("id").alias("key")), "lookup")  # a small file, so the optimizer would
    joined = lookup_join(big, lookup, ["key"], how, spread_by=["id"], broadcast_rows=29)
    assert "Broadcast" not in plan_of(joined)
    assert joined.count() == {"left": 1000, "left_anti": 250}.get(how, 750)
