"""Landed REST API responses to a table.

The HTTP call itself is not part of this library; responses are landed as
files or rows ``(endpoint, params, body)`` and parsed on executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkeda.dataset import Dataset
from sparkeda.operators.nested import payloads_to_table


def read_api_payloads(spark: SparkSession, source, path: str | None = None, body: str = "body",
                      name: str = "api_dataset", keep=("endpoint",), check: bool = True, strict: bool = False) -> Dataset:
    """Payloads from a JSON-lines folder (``endpoint, params, body``) or a DataFrame.

    ``path`` is the dotted location of the records (J1); otherwise they are
    detected (J2).  Malformed payloads and those without the path have no records; ``metadata`` counts
    them (``malformed``, ``without_path``), ``nested.bad_payloads`` lists
    them, and ``strict`` makes a missing path an error.  Provenance (endpoint, params, path) goes to ``metadata``."""
    df = source if isinstance(source, DataFrame) else spark.read.json(source)
    keep = [k for k in keep if k in df.columns]
    counts: dict = {}
    table = payloads_to_table(df, body=body, path=path, keep=keep, check=check, strict=strict, counts=counts)
    meta = {"format": "API", "records_path": path}
    if not strict:
        meta.update(counts)
    if "params" in df.columns:
        meta["params_column"] = "params"
    origin = source if isinstance(source, str) else "dataframe"
    return Dataset(name=name, df=table, origin=origin, metadata=meta)
