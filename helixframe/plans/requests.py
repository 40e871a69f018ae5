"""Searches asked for as JSON: which index, which settings, which sequences, which queries.

A field that is missing, null or 0 leaves the default; shares may be written as
such or in ten-thousandths.
"""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from helixframe.functions import seeds
from helixframe.operators import index as ix
from helixframe.plans.search import SearchConfig, search

#: Request field -> setting.
FIELDS = {
    "mode": "mode",
    "stage1_topn": "stage1_top",
    "stage2_max_gap": "max_gap",
    "stage2_max_lookback": "lookback",
    "stage2_max_nhit_per_subject": "max_chains",
    "stage2_min_diag_hits": "min_diagonal",
    "stage2_min_score": "chain_minimum",
    "num_results": "results",
    "strand": "strand",
    "max_degen_expand": "expand",
    "stage3_gapopen": "gap_open",
    "stage3_gapext": "gap_extend",
    "stage3_score_matrix": "matrix",
    "stage3_min_npositive": "min_npositive",
    "stage1_max_freq": "max_freq",
    "stage1_min_score": "min_score",
    "stage1_max_freq_frac": "max_freq",
    "stage1_min_score_frac": "min_score",
}
#: Request field -> setting and the number its unit divides by.
SCALED = {"stage1_max_freq_frac_x10000": ("max_freq", 10_000), "stage1_min_score_frac_x10000": ("min_score", 10_000), "stage3_min_ppositive_x100": ("min_ppositive", 100)}
TEMPLATES = {"coding": "cod", "optimal": "opt", "both": "both", 1: "cod", 2: "opt", 3: "both"}


def settings(request: dict, default: SearchConfig = SearchConfig()) -> SearchConfig:
    given = {name: request[field] for field, name in FIELDS.items() if request.get(field)}
    given |= {name: request[field] / unit for field, (name, unit) in SCALED.items() if request.get(field)}
    if request.get("stage1_score"):
        given["matches"] = request["stage1_score"] == 2
    if request.get("stage3_traceback"):
        given["trace"] = True
    if "accept_qdegen" in request:
        given["accept_degenerate"] = bool(request["accept_qdegen"])
    if request.get("context_frac_x10000"):
        given["context"] = f"{request['context_frac_x10000'] / 10_000:.4f}"
    elif request.get("context_abs"):
        given["context"] = str(request["context_abs"])
    return replace(default, **given)


def answer(spark: SparkSession, roots: dict[str, str], text: str, default: SearchConfig = SearchConfig(), k: int = 0) -> DataFrame:
    """Hits of a request. roots: index root of each database; k: what a request without one gets.

    Raises ValueError for an unknown database, a missing index and requests without queries.
    """
    request = json.loads(text)
    name = request.get("db") or (next(iter(roots)) if len(roots) == 1 else "")
    if name not in roots:
        raise ValueError(f"no database {name!r}")
    if not request.get("queries"):
        raise ValueError("no queries")
    k, span = request.get("k") or k, request.get("t") or 0
    kind = TEMPLATES[request.get("template_type") or "coding"]
    have = {(r.k, r.span, r.template) for r in ix.discover(spark, roots[name]).collect()}  # a row for each index
    wanted = [(k, span, t) for t in seeds.templates(span, kind)]
    if not have.issuperset(wanted):
        raise ValueError(f"no index {wanted} of {name!r}")
    indexes = [ix.read(spark, roots[name], *w) for w in wanted]
    queries = spark.createDataFrame([(q["qseqid"], q["sequence"], i) for i, q in enumerate(request["queries"])], "qseqid string, seq string, ord long")
    listed = request.get("seqidlist_mode", "none")
    names = spark.createDataFrame([(a,) for a in request.get("seqids", [])], "accession string") if listed != "none" else None
    return search(indexes, queries, settings(request, default), names, listed == "exclude")
