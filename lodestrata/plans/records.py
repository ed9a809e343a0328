"""Queries over nested records (problem 1).

Of each node a flat table names the usual fields; all its other scalars stand in the map ``rest`` beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested
from ..session import table


_PARAMS, _POLLED = r"^/events/\*/params/", r"^/polledData/"


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.triples(table(spark, sf_dir, "netlog_captures"), "capture_id", "record")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object that is an array element, with its nearest enclosing one."""
    return nested.nodes(table(spark, sf_dir, "netlog_captures"), "capture_id", "record").select("capture_id", "node_path", "parent_path")


def p1_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of events; nested objects without a list of their own stay columns of it."""
    fields = {
        "/type": "type",
        "/phase": "phase",
        "/time": "time",
        "/source/id": "source_id",
        "/source/type": "source_type",
        "/source/start_time": "source_start_time",
        "/params/net_error": "net_error",
        "/params/host": "host",
    }
    return nested.flat_table(_triples(spark, sf_dir), "capture_id", F.col("grp") == "/events/*", fields)


def p1_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists below an event's params, with the event as parent or ancestor; ``grp`` names each list's table."""
    fields = {"/address": "address", "/port": "port", "/stream": "stream", "/bytes": "bytes", "/name": "name", "/subject": "subject", "/dns": "dns", "/ms": "ms", "/n": "n"}
    return nested.flat_table(_triples(spark, sf_dir), "capture_id", _PARAMS, fields)


def p1_polled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists below polledData: sessions, streams, socket pools at any depth, alternative services; by ``grp``."""
    fields = {"/source_id": "source_id", "/host_port_pair": "host_port_pair", "/id": "id", "/name": "name", "/max": "max", "/server": "server", "/alpn": "alpn", "/port": "port"}
    return nested.flat_table(_triples(spark, sf_dir), "capture_id", _POLLED, fields)


def p1_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record's own scalars: those that every capture should have, and in ``rest`` all others outside lists."""
    fields = {
        "/constants/clientInfo/name": "client_name",
        "/constants/clientInfo/version": "client_version",
        "/constants/clientInfo/os": "client_os",
        "/constants/timeTickOffset": "time_tick_offset",
    }
    return nested.record_table(_triples(spark, sf_dir), "capture_id", fields)


def p1_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists that none of the tables above holds: those of the constants, and wherever else records have some."""
    held = (F.col("grp") == "/events/*") | F.col("grp").rlike(_PARAMS) | F.col("grp").rlike(_POLLED)
    return nested.flat_table(_triples(spark, sf_dir), "capture_id", ~held, {"/trial": "trial", "/group": "group"})


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that the records fall into."""
    return nested.groups(_triples(spark, sf_dir))


def p1_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the table that each group is pivoted into by ``nested.group_tables``."""
    return nested.schema(_triples(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_schema, p1_found, p1_events, p1_params, p1_polled, p1_constants, p1_others, p1_groups)}
SQL: dict[str, str] = {}
