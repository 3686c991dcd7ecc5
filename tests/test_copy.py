"""Card copy keeps its JSON types from the text to the validated card."""
from voxtable.operators import cards as CA
from voxtable.sources import answers as AN

COPY = """{"beats": {"b0": {"value": "42", "label": "[live]"}, "b1": {"number": "1", "title": true}, "b2": {"options": ["a", 5, "b", {"x": 1}], "pickedIndex": "1", "confidencePct": null},
 "b3": {"items": [{"emoji": "E", "label": "one two three four five"}, "loose", {"emoji": 7, "label": "x"}, {"label": "none"}]}}, "hook": {"word": "Stop", "line": 5},
 "corrections": [{"i": 12, "text": "ok"}, {"i": 12.0, "text": "same"}, {"i": 12.5, "text": "no"}, {"i": "3", "text": "no"}, {"i": 4, "text": 9}, {"i": 123456789012, "text": "far"}, 3]}"""


def test_types_survive(spark, rows):
    texts = rows("clip_id bigint, text string", (1, COPY), (2, "no json"), (3, None))
    fields, corrections = AN.read_copy(texts)
    got = {(r.unit, r.field): r for r in fields.collect()}
    assert {k: (r.kind, r.value) for k, r in got.items()} == {
        (0, "value"): ("string", "42"), (0, "label"): ("string", "[live]"), (1, "number"): ("string", "1"), (1, "title"): ("boolean", "true"),
        (2, "options"): ("array", None), (2, "pickedIndex"): ("string", "1"), (3, "items"): ("array", None)}
    assert got[2, "options"]["items"] == ["a", "b"] and [(x.emoji, x.label) for x in got[3, "items"].icons] == [("E", "one two three four five"), ("7", "x")]
    assert sorted((r.i, r.text) for r in corrections.collect()) == [(12, "ok"), (12, "same"), (123456789012, "far")]
    assert [(r.word, r.line) for r in AN.read_title(texts).collect()] == [("Stop", None)]
    cards = rows("clip_id bigint, unit bigint, template string", (1, 0, "stat_number"), (1, 1, "numbered_point"), (1, 2, "option_chips"), (1, 3, "icon_row"))
    good, bad = CA.validate_cards(cards, fields, CA.card_schema(spark))
    valid = {(r.unit, r.field): (r.value, r["items"], r.emoji) for r in good.collect()}
    assert [r.unit for r in bad.collect()] == [1]
    assert valid[0, "value"] == ("42", None, None) and valid[2, "options"] == (None, ["a", "b"], None) and valid[2, "pickedIndex"] == ("1", None, None)
    assert valid[3, "items"] == (None, ["one two three four", "x"], ["E", "7"])
