"""Random commit sequences replayed against a dict model: every version stays readable."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark import Ledger
from tidemark.session import scratch_path

KEYS = st.integers(min_value=0, max_value=12)
OPS = st.lists(
    st.one_of(
        st.tuples(st.just("append"), st.lists(KEYS, max_size=4, unique=True)),
        st.tuples(st.just("merge"), st.lists(KEYS, max_size=4, unique=True)),
        st.tuples(st.just("update"), st.lists(KEYS, max_size=3, unique=True)),
        st.tuples(st.just("delete"), st.lists(KEYS, max_size=3, unique=True)),
        st.tuples(st.just("compact"), st.just([])),
    ),
    min_size=1, max_size=5)

SCHEMA = "k INT, v STRING"


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(ops=OPS)
def test_random_histories_match_model(spark, ops):
    led = Ledger.open(spark, scratch_path(spark, "prop"))
    led.create_table("t.x", SCHEMA, keys=["k"], commit_id="c0")
    model: dict[int, str] = {}
    versions = [("c0", {})]
    for i, (op, keys) in enumerate(ops):
        tag = f"s{i}"
        cid = f"c{i + 1}"
        if op == "append":
            new = [k for k in keys if k not in model]
            if not new:
                continue
            led.append("t.x", spark.createDataFrame([(k, tag) for k in new], SCHEMA), commit_id=cid)
            model.update({k: tag for k in new})
        elif op == "merge":
            if not keys:
                continue
            led.merge("t.x", spark.createDataFrame([(k, tag) for k in keys], SCHEMA), on=["k"],
                      update_set={"v": "source.v"}, commit_id=cid)
            model.update({k: tag for k in keys})
        elif op == "update":
            if not keys:
                continue
            where = f"k IN ({', '.join(map(str, keys))})"
            led.update("t.x", {"v": f"'{tag}'"}, where=where, commit_id=cid)
            model.update({k: tag for k in keys if k in model})
        elif op == "delete":
            if not keys:
                continue
            led.delete("t.x", f"k IN ({', '.join(map(str, keys))})", commit_id=cid)
            for k in keys:
                model.pop(k, None)
        else:
            led.compact("t.x")
            continue
        versions.append((cid, dict(model)))
    for cid, want in versions:
        got = {r.k: r.v for r in led.read("t.x", commit=cid).collect()}
        assert got == want, (cid, ops)
