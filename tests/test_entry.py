import os
import re

import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="standard tables are not here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rest_of_the_library_does_not_need_llm():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "siftgrid")
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name), encoding="utf-8") as source:
                        assert not re.search(r"\bllm\b", source.read()), name
