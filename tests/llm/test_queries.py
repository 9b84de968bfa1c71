"""The registered queries: SQL twins, contracts of the digests, and that nothing else needs this package."""

import os
import shutil
import subprocess
import sys

import pytest
from compare import assert_same

from tickweave.llm import queries

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
COLUMNS = {
    "op1_quality": {"doc_id", "held_out", "score", "predicted"},
    "op2_ngram_join": {"doc_id", "n_shingles", "component_id"},
    "op3_html_text": {"page_id", "url", "text", "n_chars"},
    "op4_decontaminate": {"doc_id", "item_id"},
    "op5_licenses": {"doc_id", "license"},
    "op6_top_k": {"query_id", "rank", "vec_id", "score"},
    "op7_mixing": {"doc_id", "source"},
    "op8_chat": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op9_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op10_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op11_divergence": {"lang", "source", "part", "item", "value", "rank"},
    "op12_filter_audit": {"part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"},
    "op13_line_dedup": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(name, spark, sf_dir, duck):
    assert_same(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(queries.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(name, spark, sf_dir):
    df = queries.QUERIES[name](spark, sf_dir)
    assert COLUMNS[name] <= set(df.columns) and df.count() > 0


def test_rest_works_without_this_package(tmp_path):
    for name in ("tickweave", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy)(f"{ROOT}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "tickweave/llm")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.stdout.split()[-1] == "False" and int(said.stdout.split()[0]) > 50, said.stderr
