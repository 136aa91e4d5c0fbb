"""Readers of JSON artifacts over malformed files: each fault is told with its place and text, and what lies beside it is read."""

import json

import pytest

from recollect.sources import strict, tables


def belief(attribute="fur", confidence=0.5, **more):
    return {"attribute": attribute, "confidence": confidence, **more}


def turn(n, positives=(), negatives=(), question="q", answer="a"):
    return {"turn": n, "question": question, "answer": answer, "positives": list(positives), "negatives": list(negatives)}


def artifact(*dialogs):
    return {"schema_version": 2, "status": "complete", "dialogs": list(dialogs)}


def lines(tmp_path, *records):
    p = tmp_path / "in"
    p.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in records), encoding="utf-8")
    return str(p)


def told(read):
    return sorted((r.place, r.reason) for r in read.faults.collect())


def test_beliefs_level_by_level(spark, tmp_path):
    good = belief("  grey fur ", 1, fact_type="colour")
    bad = [belief(5), belief(""), belief(confidence="high"), belief(confidence=True), belief(confidence=None), {"attribute": "x"}, None, "fur", belief(confidence=-0.1), belief(fact_type=3), belief(fact_type=" ")]
    a = artifact(
        {"dialog_id": 0, "turns": [turn(0, [good], [*bad, good]), turn("1", [good]), turn(2, [good], question=None), turn(3, [], [good]), {"turn": 4}, None]},
        {"dialog_id": "1", "turns": []}, {"dialog_id": 2, "turns": None}, None, {"dialog_id": 4, "turns": [turn(0, [good])]}, {"dialog_id": 5, "turns": []},
    )
    read = strict.beliefs(spark, lines(tmp_path, a, "", "  ", '{"dialogs": null}', "[1]", json.dumps(a)[:90], "7"))
    rows = sorted(tuple(r) for r in read.rows.select("position", "turn_position", "session_id", "feedback_turn", "polarity", "idx", "attribute", "confidence", "fact_type").collect())
    of = ("grey fur", 1.0, "colour")
    assert rows == [(0, 0, 0, 0, "negative", 11, *of), (0, 0, 0, 0, "positive", 0, *of), (0, 3, 0, 3, "negative", 0, *of), (4, 0, 4, 0, "positive", 0, *of)]
    at = "dialogs[0].turns[0].negatives"
    want = [(f"{at}[{k}]", r) for k, r in enumerate(["attribute_not_a_text", "attribute_empty", *["confidence_not_a_number"] * 4, "not_an_object", "not_an_object", "confidence_out_of_range", "fact_type_not_a_text", "fact_type_empty"])]
    want += [("dialogs[0].turns[1]", "turn_not_a_whole_number"), ("dialogs[0].turns[2]", "question_not_a_text"), ("dialogs[0].turns[5]", "not_an_object")]
    want += [("dialogs[0].turns[4]", f"{f}_not_{k}") for f, k in (("positives", "a_list"), ("negatives", "a_list"), ("question", "a_text"), ("answer", "a_text"))]
    want += [("dialogs[1]", "dialog_id_not_a_whole_number"), ("dialogs[2]", "turns_not_a_list"), ("dialogs[3]", "not_an_object"), ("", "dialogs_not_a_list"), ("", "not_an_object"), ("", "not_an_object"), ("", "not_json")]
    assert told(read) == sorted(want)
    raw = {r.place: r.raw for r in read.faults.where("place <> ''").collect()}
    assert json.loads(raw[f"{at}[2]"]) == belief(confidence="high") and json.loads(raw["dialogs[2]"]) == {"dialog_id": 2, "turns": None}
    assert json.dumps(a)[:90] in {r.raw for r in read.faults.where("reason = 'not_json'").collect()}


def test_malformed_input_raises_by_default(spark, tmp_path):
    with pytest.raises(ValueError, match="confidence_not_a_number at dialogs.0..turns.0..positives.0."):
        tables.read_beliefs(spark, lines(tmp_path, artifact({"dialog_id": 0, "turns": [turn(0, [belief(confidence="high")])]})))
    for reader, record in ((tables.read_beliefs, '{"dialogs": [}'), (tables.read_structured, '{"items": [}'), (tables.read_configs, '{"memory": {"unheard_of": 1}, "config_id": 1}'), (tables.read_traces, '{"session_id": 1, "turn": 0}')):
        with pytest.raises(ValueError, match="malformed"):
            reader(spark, lines(tmp_path, record))


def test_one_artifact_a_file(spark, tmp_path):
    (tmp_path / "some").mkdir()
    for k in range(3):
        (tmp_path / "some" / f"{k}.json").write_text(json.dumps(artifact({"dialog_id": k, "turns": [turn(0, [belief()])]}), indent=2))
    assert tables.read_beliefs(spark, str(tmp_path / "some"), one_a_file=True).count() == 3
    (tmp_path / "some" / "3.json").write_text("{\n")
    read = strict.beliefs(spark, str(tmp_path / "some"), True)
    assert told(read) == [("", "not_json")] and read.faults.first().file == "3.json" and read.rows.count() == 3


def test_structured_items(spark, tmp_path):
    item = {"dialog_id": 1, "turn": 0, "negative_attribute": "fur", "actionable_negative": True, "typing": {"type": " global", "status": "sure"}}
    items = [item, item | {"negative_index": 1, "typing": None}, item | {"negative_index": 2, "typing": {"type": 4}}, item | {"turn": 1.5}, item | {"turn": 7, "actionable_negative": "yes"}, item | {"turn": 8}, item | {"turn": 8, "negative_attribute": "x"}, 9]
    read = strict.structured(spark, lines(tmp_path, {"items": items}))
    assert [tuple(r) for r in read.rows.collect()] == [(1, 0, 0, "fur", True, "GLOBAL", "sure", None)]
    assert told(read) == sorted([("items[1]", "typing_not_an_object"), ("items[2]", "typing.type_not_a_text"), ("items[3]", "turn_not_a_whole_number"), ("items[4]", "actionable_negative_not_a_flag"), ("items[5]", "stands_twice"), ("items[6]", "stands_twice"), ("items[7]", "not_an_object")])


def test_configs(spark, tmp_path):
    ok = [{"config_id": 1}, {"config_id": 2, "memory": {"negative_weight": 1, "semantic_merge": True, "positive_weight": 9}, "top_k": 5}]
    bad = [{"memory": {}}, {"config_id": 4, "memory": []}, {"config_id": 5, "memory": {"max_concepts": 1.5, "recency_decay": "0.1"}}, {"config_id": 6, "memory": {"zeal": 1, "ardour": 2}}, {"config_id": 7, "top_k": None}]
    read = strict.configs(spark, lines(tmp_path, *ok, *bad))
    assert sorted((r.config_id, r.negative_weight, r.max_concepts, r.semantic_merge, r.top_k) for r in read.rows.collect()) == [(1, 0.275, 50.0, False, 1000), (2, 1.0, 50.0, True, 5)]
    want = ["config_id_not_a_whole_number", "memory_not_an_object", "memory.max_concepts_not_a_whole_number", "memory.recency_decay_not_a_number", "unknown_setting_ardour_zeal", "top_k_not_a_whole_number"]
    assert [r for _, r in told(read)] == sorted(want)


def test_traces(spark, tmp_path):
    one = {"session_id": 1, "turn": 0, "final_rank": 2, "top_k": [4, 5]}
    read = strict.traces(spark, lines(tmp_path, one, one | {"turn": 1}, one | {"turn": 1}, one | {"turn": 2, "top_k": [1, "2"]}, one | {"turn": 3, "top_k": 5}, one | {"turn": 4, "mem_negative": "1"}, '{"session_id": 1,'))
    assert [tuple(r) for r in read.rows.collect()] == [(1, 0, 2, [4, 5], None)]
    assert [r for _, r in told(read)] == sorted(["stands_twice", "stands_twice", "top_k_holds_no_whole_number", "top_k_not_a_list", "mem_negative_not_a_whole_number", "not_json"])
