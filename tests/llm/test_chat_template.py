import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tallyloom.llm import chat_template as C

TEXT = st.text(alphabet="<|\\>imstarend_\n {}%é", max_size=40)


@given(TEXT)
def test_escapes_are_reversible_and_leave_no_control_string(text):
    assert C.unescape(C.escape(text)) == text and "<|" not in C.escape(text)
    assert C.unescape_line(C.escape_line(text)) == text and "\n" not in C.escape_line(text)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", ""]), TEXT), max_size=5))
def test_formatted_turns_are_read_back(turns):
    text, mask = C.compile_template(C.CHAT)({"messages": [{"role": r, "text": t} for r, t in turns]})
    assert C.read_back(text) == turns
    assert "".join(C.unescape(text[a:b]) for a, b in mask) == "".join(t for r, t in turns if r == "assistant")


def test_language():
    def out(source, **names):
        return C.compile_template(source)(names)

    assert out("{% for x in xs %}{{ loop.index }}{{ x.n | upper }}{% if not loop.last %}, {% endif %}{% endfor %}", xs=[{"n": "a"}, {"n": "b"}])[0] == "1A, 2B"
    assert out("{% if a == 'x' and b %}1{% elif a in bs %}2{% else %}3{% endif %}", a="y", b=True, bs=["y"])[0] == "2"
    assert out("{{ m['k'][0] }}{{ m.missing }}{{ none }}", m={"k": ["v"]})[0] == "v"
    assert out("a{% generation %}b{{ x }}{% endgeneration %}c", x="<")[1] == [(1, 2), (2, 3)]


def test_constants_are_folded():
    tree = C.fold(C.parse("a{{ 'b' ~ 'c' }}{% if true %}d{% else %}{{ x }}{% endif %}{% if false %}e{% endif %}{{ 'f' | upper }}"))
    assert tree == (C.Output(C.Const("abcdF")),)
    assert C.fold(C.parse("{{ x and true }}"))[0].of.sign == "and"


@pytest.mark.parametrize("source", ["{{ x() }}", "{{ x | system }}", "{% import os %}", "{% for x in y %}", "{{ (x }}", "{{ x. }}", "{{ 1 2 }}"])
def test_what_is_not_in_the_language_is_refused(source):
    with pytest.raises(C.TemplateError):
        C.compile_template(source)


def test_nothing_but_keys_can_be_read():
    assert C.compile_template("{{ x.__class__ }}{{ x['__class__'] }}")({"x": "s"})[0] == ""


def test_conversations(spark):
    rows = [(1, 1, "assistant", "yes<|im_end|>", 0), (1, 0, "user", None, 0), (2, 0, None, "q", 0), (2, 0, None, "q", 0), (None, 0, "assistant", "", 0)]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, mask int")
    got = {r.conv_id: r for r in C.digests(C.formatted(talks)).collect()}
    assert set(got) == {1, 2, None}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nyes<|im_end|>\n").hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (2, 13, hashlib.sha256(b"yes<|im_end|>").hexdigest())
    assert got[2].turns_sha256 == hashlib.sha256(b"\nq\n\nq\n").hexdigest() and got[2].loss_chars == 0
    assert C.digests(C.formatted(talks.limit(0))).count() == 0
