import pytest

from skeinwork.llm import chat

M = [{"role": "system", "content": "S"}, {"role": "user", "content": " hi "}, {"role": "assistant", "content": "yo"}]


def text(source, **names):
    return chat.Template(source).render(**names)[0]


@pytest.mark.parametrize(
    "source,want",
    [
        ("a{{ 1 + 2 * 3 }}b", "a7b"),
        ("{% for m in messages %}{{ loop.index }}{{ m.role }}{% if not loop.last %},{% endif %}{% endfor %}", "1system,2user,3assistant"),
        ("{% if messages[0]['role'] == 'system' %}{% set s = messages[0].content %}{% set messages = messages[1:] %}{% endif %}{{ s }}{{ messages|length }}", "S2"),
        ("{% set ns = namespace(n=0) %}{% for m in messages %}{% set ns.n = ns.n + 1 %}{% endfor %}{{ ns.n }}", "3"),
        ("{% for m in messages if m.role != 'user' %}{{ m.role[0] }}{% endfor %}", "sa"),
        ("{% for x in [] %}a{% else %}none{% endfor %}", "none"),
        ("{% for x in range(5) %}{% if x == 1 %}{% continue %}{% elif x == 3 %}{% break %}{% endif %}{{ x }}{% endfor %}", "02"),
        ("a  {%- if true %}  b  {%- endif %}\n  c", "a  b  c"),
        ("{% if true %}\nx\n{% endif %}\ny", "x\ny"),
        ("  {% if true %}\n  z\n  {% endif %}\n", "  z\n"),
        ("{# gone #}{{ '}}' }}", "}}"),
        ("{{ 'a' if x is defined else 'b' }}", "b"),
        ("{{ x | default('d') | upper }}{{ ' a ' | trim ~ 1 }}", "Da1"),
        ("{{ {'a': [1, 2]} | tojson }}", '{"a": [1, 2]}'),
        ("{{ 'a,b'.split(',') | join('-') }}{{ 'x' in ['x'] and 'y' not in 'xz' }}", "a-bTrue"),
        ("{% for k, v in {'p': 1}.items() %}{{ k }}{{ v }}{% endfor %}", "p1"),
        ("{{ 1 < 2 < 3 }}{{ messages | selectattr('role', 'equalto', 'user') | map(attribute='content') | first | trim }}", "Truehi"),
        ("", ""),
    ],
)
def test_language(source, want):
    assert text(source, messages=M) == want


def test_constants_are_folded():
    assert chat.Template("a{{ 'b' ~ 1 + 1 }}{% if 1 == 1 and not false %}c{% else %}{{ x }}{% endif %}{{ 'D'|lower }}").tree == ("block", [("text", "ab2cd")])
    assert chat.Template("{{ 1 // 0 if false else 'ok' }}").tree == ("block", [("text", "ok")])


@pytest.mark.parametrize("source", ["{{ x", "{% if x %}", "{% endif %}", "{{ x.__class__() }}", "{{ open('f') }}", "{% import os %}", "{{ 1 + }}", "{{ x | eval }}", "{% break %}", "{{ 'a'.format(1) }}"])
def test_what_does_not_compile(source):
    with pytest.raises(chat.TemplateError):
        chat.Template(source)


def test_sandbox():
    assert text("{{ messages.__class__ }}{{ m['__class__'] }}{{ 'a'.__len__ }}", messages=M, m={}) == ""
    for source in ("{{ 'a' * 99999999 }}", "{{ range(99999999) }}", "{% for i in range(9999) %}{% for j in range(9999) %}{% endfor %}{% endfor %}", "{{ raise_exception('no') }}", "{{ '%9999999d' % 1 }}"):
        with pytest.raises(chat.TemplateError):
            text(source)


def test_generation_spans():
    t = chat.Template("{% for m in messages %}{% if m.role == 'assistant' %}<{% generation %}{{ m.content }}é!{% endgeneration %}>{% else %}{{ m.content }}{% endif %}{% endfor %}")
    out, spans = t.render(messages=M + M)
    assert [out[a:b] for a, b in spans] == ["yoé!", "yoé!"]


def test_frames(spark):
    rows = [(1, 1, "assistant", "b", "x"), (1, 0, "user", "a", "x"), (1, None, "user", "last", "x"), (2, 0, None, None, "x"), (None, 0, "user", "n", "x"), (3, 0, "user", "d", "x"), (3, 0, "user", "d", "x"), (4, 0, "assistant", "z" * 300_000, "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, messages string")
    got = {r.conv_id: r for r in chat.render(df).collect()}
    assert set(got) == {1, 2, 3, 4, None} and all(r.error is None for r in got.values())
    assert got[1].text == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nlast<|im_end|>\n"
    assert [got[1].text[s.start : s.end] for s in got[1].spans] == ["b<|im_end|>"]
    assert got[2].text == "<|im_start|>\n<|im_end|>\n" and got[3].n_turns == 2
    failed = {r.conv_id: r for r in chat.render(df, "{% if messages|length > 2 %}{{ raise_exception('long') }}{% endif %}ok").collect()}
    assert failed[1].text is None and "long" in failed[1].error and failed[2].text == "ok"
    assert chat.render(df.limit(0)).collect() == []


def test_query(spark, medium, against_sql):
    against_sql(chat.op6_chat_format(spark, medium), chat.SQL, medium)


def test_the_bounds_grow_with_the_conversation(spark):
    """Only templates that run away meet the bounds of steps and characters."""
    turns = [{"role": "user", "content": "x" * 10}] * 300
    t = chat.Template("{% for m in messages %}{{ m.content | trim }}{% endfor %}")
    assert t.render(messages=turns, max_steps=0, max_chars=0)[0] == "x" * 3000
    wild = chat.Template("{% for m in messages %}{% for n in messages %}{% for o in range(100) %}x{% endfor %}{% endfor %}{% endfor %}")
    with pytest.raises(chat.TemplateError, match="too many steps|too much output"):
        wild.render(messages=turns, max_steps=0, max_chars=0)
    df = spark.createDataFrame([(1, k, "user", "y") for k in range(40)], "conv_id bigint, turn int, role string, text string")
    source = "{% for m in messages %}{% for n in range(20000) %}{% endfor %}{{ m.content }}{% endfor %}"
    assert chat.render(df, source).first().text == "y" * 40
    assert "too many steps" in chat.render(df, source, max_steps=10).first().error
