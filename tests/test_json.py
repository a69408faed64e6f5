"""JSON bodies keep everything but their texts, byte for byte, and nothing passes unread."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.functions.json_tree import JsonText, read
from veilframe.functions.restorer import Restorer
from veilframe.operators import gateway
from veilframe.options import Options
from veilframe.streaming.sse import EventRestorer

VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=3), x, max_size=4), max_leaves=20)


def strings(value):
    if isinstance(value, str):
        return [value]
    return [s for x in (value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()) for s in strings(x)]


@settings(max_examples=300, deadline=None)
@given(VALUES, st.sampled_from([None, 2]), st.booleans())
def test_reads_what_the_library_writes(value, indent, plain):
    text = json.dumps(value, indent=indent, ensure_ascii=plain)
    tree = JsonText(text)
    assert [tree.string(n) for n in tree.strings()] == strings(value)
    assert tree.spliced([(n, tree.string(n)) for n in tree.strings()]) == text
    twice = json.loads(tree.spliced([(n, tree.string(n) * 2) for n in tree.strings()]))
    assert strings(twice) == [s * 2 for s in strings(value)]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet='{}[],:"\\0123456789.eE+-truefalsn \tu', max_size=14))
def test_refuses_what_the_library_refuses(text):
    def no(_):
        raise ValueError

    try:
        json.loads(text, parse_constant=no)
        good = True
    except ValueError:
        good = False
    assert (read(text) is not None) == good


NUMBERS = '{"n": 1.10, "n":1e400, "big": 12345678901234567890.123456789, "long": ' + "7" * 5000 + ', "system" : "Mail a@b.ch", "messages": [{"content": "a@b.ch\\u0021 \\/"}, {"content": "kein \\u00e4 \\/"}], "n":[ -0.0 ]}'
TWICE = '{"system":"a@b.ch","system":"c@d.ch","messages":[{"content":[{"type":"x","type":"text","text":"e@f.ch","text":"a@b.ch"}]}]}'


def test_bodies_stay_byte_for_byte(spark):
    deep = '{"messages":[{"content":' + '[{"content":' * 3000 + '"a@b.ch"' + ',"type":"tool_result"}]' * 3000 + "}]}"
    bodies = {1: NUMBERS, 2: TWICE, 3: deep, 4: '{"system": "a@b.ch", "n": NaN}', 5: '{"system": "a@b.ch"', 6: '["a@b.ch"]', 7: "Mail an a@b.ch", 8: "", 9: None, 10: '{"a@b.ch": "a@b.ch"}'}
    df = spark.createDataFrame(list(bodies.items()), "request_id long, body string")
    out, mapping = gateway.anonymize_requests(df, Options.only("emails"))
    got = {r.request_id: r.body for r in out.collect()}
    assert got[1] == NUMBERS.replace("Mail a@b.ch", "Mail [EMAIL_1]").replace('"a@b.ch\\u0021 \\/"', '"[EMAIL_1]! /"')
    assert got[2] == '{"system":"[EMAIL_1]","system":"[EMAIL_2]","messages":[{"content":[{"type":"x","type":"text","text":"[EMAIL_3]","text":"[EMAIL_1]"}]}]}'
    assert got[3] == deep.replace("a@b.ch", "[EMAIL_1]")
    # no JSON is one text, JSON without texts stays
    assert got[4] == '{"system": "[EMAIL_1]", "n": NaN}' and got[5] == '{"system": "[EMAIL_1]"' and got[7] == "Mail an [EMAIL_1]"
    assert got[6] == bodies[6] and got[8] == "" and got[9] is None and got[10] == bodies[10]
    back = {r.request_id: r.body for r in gateway.restore_responses(out, mapping).collect()}
    assert back == {**bodies, 1: NUMBERS.replace('"a@b.ch\\u0021 \\/"', '"a@b.ch! /"')}


@pytest.mark.parametrize("number", ["1.10", "1e400", "9" * 6000])
def test_numbers_in_events_and_responses(number):
    restore = Restorer([("[NAME_1]", "Max")])
    assert gateway.restore_values('{"x":%s, "y":["[NAME_1]",%s]}' % (number, number), restore) == '{"x":%s, "y":["Max",%s]}' % (number, number)
    machine = EventRestorer([("[NAME_1]", "Max")])
    event = 'data:  {"type":"content_block_delta","n":%s,"index":0,"delta":{"type":"text_delta","text":"[NAME_1]!"}}\r\n\r\n' % number
    assert machine.push(event) == event.replace("[NAME_1]", "Max")


def test_strings_without_escapes_are_read_as_they_stand(monkeypatch):
    from veilframe.functions import json_tree

    calls, loads = [], json_tree.json.loads
    monkeypatch.setattr(json_tree.json, "loads", lambda s: calls.append(s) or loads(s))
    tree = json_tree.JsonText('{"a": "é 🎉", "\\u0061": ["x\\n\\"y", {}], "": ""}')
    assert [tree.string(n) for n in tree.strings()] == ["é 🎉", 'x\n"y', ""]
    assert calls == ['"x\\n\\"y"']
    assert len(tree.members(tree.root, "a")) == 2
