"""Training-data operators. Nothing else in the library imports this subpackage."""

from importlib import import_module

#: Query name -> module. Each module has query(spark, sf_dir) and ORACLE (DuckDB SQL, or None where SQL can't express it).
MODULES = {
    "op1_html_mincut": "html_mincut",
    "op2_impact_topk": "impact_topk",
    "op3_piece_codec": "piece_codec",
    "op4_toxicity_kn": "toxicity_kn",
    "op5_media_audio": "media_audio",
    "op6_quality_pairs": "quality_bt",
    "op7_line_suffix": "line_suffix",
    "op8_debruijn_spans": "debruijn_spans",
    "op9_bestfit_pack": "bestfit_pack",
    "op10_count_rtree": "count_rtree",
    "op11_periodic_runs": "periodic_runs",
    "op12_hard_negatives": "hard_negatives",
    "op13_dac_output": "dac_output",
}


def queries():
    return {name: import_module(f"{__name__}.{mod}").query for name, mod in MODULES.items()}


def oracle_sql():
    found = {name: import_module(f"{__name__}.{mod}").ORACLE for name, mod in MODULES.items()}
    return {k: v for k, v in found.items() if v}
