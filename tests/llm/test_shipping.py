"""Tasks must run where the package is not installed."""

import os
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle

from leafmill.llm import bloom_lm, bytewords, near_dup, quotation, span_crf, suffix_repeats, url_terms, weak_quality, wu_manber
from leafmill.sources import pages
from leafmill.streaming import stateful

TEXT = pa.array(["some words, here", None])


@pytest.mark.parametrize(
    "task",
    [
        lambda: bytewords.split_words(TEXT).hashes,
        lambda: near_dup.minima(*near_dup.shingle_sets(TEXT, 2)),
        lambda: bloom_lm.tokens(TEXT)[0],
        lambda: list(suffix_repeats._sites(*bytewords.column_bytes(pa.array(["x" * 900])), 400)),
        lambda: weak_quality.measures(TEXT)[0],
        lambda: span_crf.base_spans("a@b.c"),
        lambda: [wu_manber._covered([(1, 2)]), wu_manber.Machine],
        lambda: [url_terms._count, quotation.parse("> a b c d\ne")],
        lambda: pages._Builder().run("<p>a<p>b"),
        lambda: stateful.SectionAssembly(),
    ],
)
def test_tasks_carry_their_code(tmp_path, task):
    task()  # what a process keeps for itself must not travel
    data = cloudpickle.dumps(task)
    assert len(data) < 1_000_000
    (tmp_path / "task").write_bytes(data)
    code = "import pickle, pyspark.cloudpickle; pickle.loads(open('task', 'rb').read())()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
