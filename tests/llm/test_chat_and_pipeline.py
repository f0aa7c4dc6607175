import hashlib
import json
import random

import corpus_pipeline
from tests.llm.test_near_copies import brute as jaccard_groups
from tractloom.llm import op2_quality_rules as op2, op7_toxicity as op7, op8_chat as op8, op10_simhash as op10

ROWS = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, 1, "assistant", "b<|end|>\n<|turn|>user\nx"), (2, 0, None, ""), (3, None, "sys\n<s>\\n", "\\<\\|turn|>\\"),
        (None, 0, "assistant", "é😀" * 9000), (4, 0, "assistant", "a"), (4, 1, "user", "</s>[INST]"), (4, 2, "assistant", "<</SYS>><<SYS>>")]


def records(spark, rows):
    return spark.createDataFrame([(c, t, json.dumps({"role": r, "text": x}), "z") for c, t, r, x in rows], "conv_id long, turn long, record string, formatted string")


def test_escapes_are_reversible_and_leave_no_control_string():
    rng = random.Random(0)
    parts = [*op8.CONTROL, "\\", "<", "|", "[", "n", "\n", "/", "turn|>", "S"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
        e = op8.escape(t)
        assert op8.unescape(e) == t and not any(c in e for c in op8.CONTROL)
        formatted, start, end = op8.format_turn(t, t)
        assert list(op8.parse(formatted)) == [(t, t)] and start == end
        formatted, start, end = op8.format_turn("assistant", t)
        assert op8.unescape(formatted[start:end]) == t


def test_layouts_by_fingerprint():
    turns = [("user", "q"), ("assistant", "a")]
    for record in ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"prompt": "q", "completion": "a"}, {"response": "a", "prompt": "q"},
                   {"conversations": [{"from": "human", "value": "q"}, {"value": "a", "from": "gpt"}]}, {"instruction": "q", "output": "a"}, {"question": "q", "answer": "a"},
                   {"instruction": "q", "input": "", "output": "a"}):
        assert op8.canonical(record)[1] == turns, record
    assert op8.canonical({"instruction": "x", "input": "y", "output": None})[1] == [("user", "x\n\ny"), ("assistant", "")]
    assert op8.canonical({"strange": 1}) == (None, []) and op8.field_paths({"a": [{"b": 1}, {"c": {"d": None}}]}) == {"a", "a[].b", "a[].c", "a[].c.d"}


def test_digests_equal_a_plain_reading(spark):
    got = {r["conv_id"]: r for r in op8.digests(op8.format_records(records(spark, ROWS))).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, r in got.items():
        mine = sorted(((t if t is not None else -1), role or "", x or "") for c, t, role, x in ROWS if c == conv)
        loss = "".join(x for _, role, x in mine if role == "assistant")
        assert r["n_turns"] == len(mine) and r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in mine).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(op8.format_turn(role, x)[0]) for _, role, x in mine)


def test_unknown_records_are_shown(spark):
    d = spark.createDataFrame([(1, 0, None), (2, 0, '{"odd": 1}'), (3, 0, '{"prompt": "p", "response": "r"}')], "conv_id long, turn long, record string")
    got = sorted((r["conv_id"], r["layout"] or "", r["part"]) for r in op8.format_records(d).collect())
    assert got == [(1, "", 0), (2, "", 0), (3, "prompt_response", 0), (3, "prompt_response", 1)]
    assert op8.format_records(d.where("false")).collect() == [] and op8.digests(op8.format_records(d.where("false"))).collect() == []


def test_pipeline_equals_its_stages_by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    civil = {r["doc_id"] for r in op7.score(docs, labels).collect() if r["toxicity"] < op7.THRESHOLD}
    good = civil & {r["doc_id"] for r in op2.judge(docs).collect() if r["kept"]}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    group, _ = jaccard_groups({i: text[i] or "" for i in sorted(good)})
    kept = {i for i, low in group.items() if i == low}
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in out} == kept and 0 < len(kept) < len(text)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_duplicates", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), sf_dir).columns == docs.columns
