"""The model boundary: context rows in, delay quantiles out, by request and key.

A backend is a function (context, query, quantiles) -> array of quantiles, one row per query row. The
one that comes with the library is the empirical quantile of the context's changes of delay; it is no
stand-in for a pretrained model's quality, and others can be passed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellwerk.operators.context import build_context
from stellwerk.operators.visibility import with_last_known
from stellwerk.schema import QUANTILES

Backend = Callable[[pd.DataFrame, pd.DataFrame, list[float]], np.ndarray]
KEY = ("request_id", "run_id", "stop_num")


def empirical(context: pd.DataFrame, query: pd.DataFrame, quantiles: list[float]) -> np.ndarray:
    """Quantiles of the context's changes: of rows with the query row's train type if there are ten, else of all."""
    by_type = {t: g["change"].to_numpy() for t, g in context.groupby("train_type") if len(g) >= 10}
    rest = np.quantile(context["change"], quantiles)
    own = {t: np.quantile(v, quantiles) for t, v in by_type.items()}
    return np.array([own.get(t, rest) for t in query["train_type"]]).reshape(len(query), len(quantiles))


def predict(context: DataFrame, query: DataFrame, model: str, quantiles=QUANTILES, backend: Backend = empirical) -> DataFrame:
    """request_id, run_id, stop_num, q..: predicted delays of the query rows.

    The target is the change since the last known delay; predictions add it back, in order within a row.
    """
    names = [f"q{round(100 * q)}" for q in quantiles]
    base = F.coalesce(F.col("last_known_delay"), F.lit(0)).cast("double")
    usable = context.filter(F.col(f"{model}_delay").isNotNull() & ~F.coalesce(F.col(f"{model}_canceled"), F.lit(False)))
    #: New names of the columns, as both sides may come from the same rows.
    rows = usable.select(F.col("request_id").alias("request_id"), F.col("train_type").alias("train_type"), (F.col(f"{model}_delay") - base).alias("change"))
    asked = query.select(*KEY, "train_type", base.alias("base"), F.col(f"planned_{model}").isNotNull().alias("exists"))

    def fit(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = q[list(KEY)].copy()
        values = np.full((len(q), len(names)), np.nan)
        if len(c) and len(q):
            values = np.sort(backend(c, q, list(quantiles)), axis=1) + q["base"].to_numpy()[:, None]
            values[~q["exists"].to_numpy(dtype=bool)] = np.nan
        out[names] = values
        return out

    schema = ", ".join(f"{c} {dict(query.dtypes)[c]}" for c in KEY) + "".join(f", {c} double" for c in names)
    found = rows.groupBy("request_id").cogroup(asked.groupBy("request_id")).applyInPandas(fit, schema)
    return found.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in names})


def predict_arrivals(stops: DataFrame, query: DataFrame, model: str = "arr", size: int = 5_000, backend: Backend = empirical, **options) -> DataFrame:
    """Context, last known delays and prediction for query rows (stops rows with request_id and now)."""
    context = build_context(stops, query, size=size, same_train_days=14, **options)
    context = with_last_known(context, stops, F.col("now"), model, True)
    return predict(context, with_last_known(query, stops, F.col("now"), model, False), model, backend=backend)
