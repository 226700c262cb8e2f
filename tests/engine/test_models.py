import pytest

from quillon import model as m


def test_camel_names():
    assert [m.camel(x) for x in ("user_id", "UserName", "a", "foo_bar_baz", "_x")] == ["userId", "userName", "a", "fooBarBaz", "x"]


@pytest.mark.parametrize(
    "build",
    [
        lambda: m.Model("M", (m.required("a", "int"), m.required("a", "int"))),
        lambda: m.Model("M", (m.required("a", "decimal"),)),
        lambda: m.Model("M", (m.required("a", "int", wire="x"), m.required("b", "int", wire="x"))),
        lambda: m.Model("M", (m.required("a", "int", flatten="x.y"), m.required("b", "int", wire="x"))),
        lambda: m.Model("M", (m.required("a", "int", flatten="x..y"),)),
        lambda: m.Model("M", (m.required("a", "int", flatten="x", wrap="y"),)),
        lambda: m.Model("M", (m.required("a", "int", keys=True),)),
        lambda: m.Model("M", (m.required("a", m.Model("N", (m.optional("b", "int"),)), keys=True, omit="empty"),)),
        lambda: m.Model("M", (m.required("a", "int", ignored=True),)),
        lambda: m.Model("M", (m.Field("a", "int", has_default=True),)),
        lambda: m.Model("M", (m.required("a", "bytes"),)),
        lambda: m.Model("M", (m.required("a", m.Model("N", (m.optional("b", "int"),)), keys=True), m.optional("b", "int"))),
        lambda: m.Enum(("a", "a")),
        lambda: m.Enum(("a",), fallback="b"),
        lambda: m.Sealed("S", {}),
        lambda: m.Sealed("S", {"a": m.Model("A", ())}, fallback="b"),
        lambda: m.Inferred("I", {"a": m.Model("A", (m.required("x", "int"),)), "b": m.Model("B", (m.required("x", "string"),))}),
        lambda: m.Envelope("t"),
        lambda: m.Envelope("t", {"a": "x", "b": "x"}),
        lambda: m.Envelope("t", data_field="d", fallback_field="x"),
        lambda: m.Envelope("t", {"a": "x"}, targets={"b": m.Model("B", ())}),
        lambda: m.check_yaml(m.Model("M", (m.optional("a", m.Model("N", (m.optional("b", "int"),))),))),
        lambda: m.check_yaml(m.Model("M", (m.optional("a", "int", resilient=True),))),
    ],
)
def test_models_that_cannot_be(build):
    with pytest.raises(m.ModelError):
        build()
