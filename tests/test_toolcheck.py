"""Tool lists, scoring, faulty calls and likeness on hard cases."""

import json

import pytest

from quarrystone.operators import evaluation, perturbation, prompts


@pytest.mark.parametrize(
    ("prompt", "want"),
    [
        ('Tools:\n[{"name": "a"}, {"name": "b"}]', [2]),
        ('<tools></tools> is empty\n<tools>\n[{"name": "a"}]\n</tools>', [1]),
        ('Tools:\n[{"name": "a"},', []),
        ('Tools: [] and more', []),
        ('Tools: []', [0]),
        (None, []),
    ],
)
def test_tool_lists(prompt, want):
    assert [len(x) for x in prompts.tool_lists(prompt)] == want


KEY = {"f": {"a": [1, 2.0], "b": ["x", ""]}}


@pytest.mark.parametrize(
    ("output", "want"),
    [
        ('so: {"name": "f", "arguments": {"a": 2}} ok', (True, True, True, "")),
        ('{"name": "f", "arguments": {"a": true}}', (True, True, True, "")),
        ('{"name": "g", "arguments": {"a": 1}}', (False, True, False, "bad_name")),
        ('{"name": "g", "arguments": {"a": 3}}', (False, False, False, "bad_value:a")),
        ('{"name": "f", "arguments": {"b": "x"}}', (True, False, False, "missing_arg:a")),
        ('{"name": "f", "arguments": {"z": 1}}', (True, False, False, "extra_arg:z")),
        ('{"name": "f", "arguments": [1]}', (False, False, False, "arguments_not_dict")),
        ('{"name": "f"}', (False, False, False, "missing_name_or_arguments")),
        ("} no {", (False, False, False, "json_unparseable")),
        (None, (False, False, False, "json_unparseable")),
    ],
)
def test_scores(output, want):
    assert evaluation.scored(output, KEY) == want


def test_faults_change_what_they_name():
    call = {"name": "f", "arguments": {"s": "abc", "n": -3, "flag": True, "l": [1], "o": {}}}
    tools = [{"name": "f", "parameters": {"required": ["n"]}}, {"name": "g"}]
    made = lambda kind, seed="0": perturbation.faulty(kind, call, tools, seed)
    assert json.loads(made("wrong_tool_from_list"))["name"] == "g"
    assert json.loads(made("hallucinated_tool"))["name"] in perturbation.FAKE_TOOLS
    assert "n" not in json.loads(made("missing_required_arg"))["arguments"]
    for seed in map(str, range(20)):
        with pytest.raises(ValueError):
            json.loads(made("malformed_json", seed))
        wrong = made("wrong_arg_value", seed)
        assert wrong is None or json.loads(wrong)["arguments"] != call["arguments"]
    assert [perturbation.other_value(v) for v in ("abc", True, 3, -3, [1], {}, "", None)] == ["cba", False, -1002, 1002, [], None, None, None]
    assert perturbation.faulty("missing_required_arg", {"name": "f"}, tools, "0") is None
    assert perturbation.faulty("wrong_tool_from_list", call, tools[:1], "0") is None


def test_lists_keep_their_other_calls():
    assert perturbation.source_call('[{"name": "f"}, 7]') == ({"name": "f"}, [7]) and perturbation.source_call("[7]") is None and perturbation.source_call("[]") is None
    assert perturbation.relisted('{"a": 1}', [{"b": 2}]) == '[{"a": 1}, {"b": 2}]' and perturbation.relisted('{"a": 1', [7]) == '[{"a": 1,7]' and perturbation.relisted("x", None) == "x"


def test_likeness():
    long = json.dumps({"name": "f", "arguments": {"a": "word " * 40}})
    assert perturbation.likeness("{}", "{}")[:4] == (True, True, False, False)
    assert perturbation.likeness('{"a": 1, "b": 2}', '{"b":2.0,"a":1}')[5] == "canonical_json_equal,length_or_whitespace_only"
    assert perturbation.likeness(long, long[:-1])[3] and perturbation.likeness(long, long[:-1])[5] == ""
    assert perturbation.likeness(long, long.replace("f", "g", 1))[5] == "near_identical_edit_distance"
