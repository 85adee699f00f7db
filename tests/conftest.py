import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def graph(spark):
    from graphloom.session import GraphSession

    return GraphSession(spark)


@pytest.fixture
def run(graph):
    """rows(text, **params): the result as tuples."""
    return lambda text, **params: [tuple(r) for r in graph.query(text, params).collect()]


@pytest.fixture
def demo(graph, spark):
    """Users who follow each other and live in cities."""
    graph.add_nodes("User", spark.createDataFrame([("Adam", 30), ("Karissa", 40), ("Zhang", 50), ("Noura", 25)], "name string, age long"), "name")
    graph.add_nodes("City", spark.createDataFrame([("Waterloo", 150000), ("Kitchener", 200000), ("Guelph", 75000)], "name string, population long"), "name")
    graph.add_rels("Follows", spark.createDataFrame([("Adam", "Karissa", 2020), ("Adam", "Zhang", 2020), ("Karissa", "Zhang", 2021), ("Zhang", "Noura", 2022)], "a string, b string, since long"), ("User", "a"), ("User", "b"), ["a", "b"])
    graph.add_rels("LivesIn", spark.createDataFrame([("Adam", "Waterloo"), ("Karissa", "Waterloo"), ("Zhang", "Kitchener"), ("Noura", "Guelph")], "a string, b string"), ("User", "a"), ("City", "b"), ["a"])
    return graph
