"""Replies are kept as they arrive."""

import os

import pytest
from pyspark.errors import PySparkException

from lectern.plans.ask import completed
from lectern.plans.ledger import Ledger


def test_a_ledger(tmp_path):
    for path in (f"{tmp_path}/a", f"file://{tmp_path}/a", f"file:{tmp_path}/a"):
        ledger = Ledger(path)
        ledger.put("ab12", "é\n")
        assert ledger.get("ab12") == "é\n" and ledger.get("ab13") is None
    assert Ledger.digest("a", "bc") != Ledger.digest("ab", "c")
    assert [f for _, _, fs in os.walk(tmp_path) for f in fs] == ["ab12.json"]


@pytest.mark.parametrize("at_once", [1, 3])
def test_a_task_that_dies_midway_asks_nothing_twice(spark, tmp_path, at_once):
    log, armed = str(tmp_path / "log"), str(tmp_path / "armed")
    open(armed, "w").close()

    def model(system, prompt):
        if "7" in prompt and os.path.exists(armed):
            os.remove(armed)
            raise SystemExit("the executor is gone")
        if "3" in prompt:
            raise ValueError("model is busy")
        with open(log, "a") as f:
            f.write(prompt + "\n")
        return f"re {prompt}"

    prompts = spark.createDataFrame([(i, f"p{i % 10}") for i in range(12)], "id long, prompt string").coalesce(1)
    with pytest.raises(PySparkException):
        completed(prompts, "s", model, f"{tmp_path}/ledger", at_once)
    for _ in range(2):
        got = {r.id: (r.answer, r.failure) for r in completed(prompts, "s", model, f"{tmp_path}/ledger", at_once).collect()}
        assert got == {str(i): (None, "model is busy") if i == 3 else (f"re p{i % 10}", None) for i in range(12)}
    asked = open(log).read().split()
    assert sorted(asked) == sorted(f"p{i}" for i in range(10) if i != 3)
