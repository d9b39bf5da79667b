import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from varloom.plans import cql
from varloom.plans.query import Filter, Query, Range, Sort

COLUMNS = ["ref", "alt", "info:DP", "sample:GQ", "annotations:gene_name"]


@pytest.mark.parametrize(
    "text, filters",
    [
        ("", ()),
        ("info:DP >= 30", (Filter("info:DP", ">=", "30"),)),
        ("ref != T", (Filter("ref", "!=", "T"),)),
        ("sample:GQ = 25", (Filter("sample:GQ", "=", "25"),)),
        ('alt like "%G%"', (Filter("alt", "LIKE", "%G%"),)),
        ("alt RLIKE '^(A|C)+$'", (Filter("alt", "RLIKE", "^(A|C)+$"),)),
        ("annotations:gene_name is null", (Filter("annotations:gene_name", "NULL"),)),
        ("sample:GQ  IS   Not  NULL", (Filter("sample:GQ", "NOT NULL"),)),
        ("alt like 'it\"s'", (Filter("alt", "LIKE", 'it"s'),)),
        ("info:DP > 5 AND ref = A and alt <= G", (Filter("info:DP", ">", "5"), Filter("ref", "=", "A"), Filter("alt", "<=", "G"))),
    ],
)
def test_filters(text, filters):
    assert cql.parse(text, COLUMNS) == Query(filters)


@pytest.mark.parametrize(
    "text, found",
    [
        ("chr7:", Range("chr7")),
        ("3:55-", Range("3", 55)),
        ("4:-16,569", Range("4", None, 16569)),
        ("chr9:1,000-2000", Range("chr9", 1000, 2000)),
    ],
)
def test_ranges(text, found):
    assert cql.parse(text, COLUMNS).range == found


def test_sorts_and_everything_together():
    q = cql.parse("ref = A AND 9:70-8,000 AND info:DP < 12 ORDER BY alt, sample:GQ DESC, ref asc", COLUMNS)
    assert q == Query((Filter("ref", "=", "A"), Filter("info:DP", "<", "12")), Range("9", 70, 8000), (Sort("alt"), Sort("sample:GQ", True), Sort("ref")))


@pytest.mark.parametrize(
    "text, message",
    [
        ("depth = 3", "Unknown field depth"),
        ("ORDER BY depth DESC", "Unknown field depth"),
        ("info:DP <", "SyntaxError"),
        ("ORDER BY", "SyntaxError"),
        ("ref = A ANDalt = C", "SyntaxError"),
        ("ref = A AND ORDER BY alt", "SyntaxError"),
        ("1: AND 2:", "Only one range is allowed"),
    ],
)
def test_errors(text, message):
    with pytest.raises(cql.QueryError, match=f"^{message}$"):
        cql.parse(text, COLUMNS)


@pytest.mark.parametrize("text", ["info:DP != 7", "X:50-60 AND ref = A", "9:-400", "alt LIKE 'G,%' ORDER BY ref DESC, alt", "annotations:gene_name IS NULL AND sample:GQ > 1"])
def test_text_of_parsed_text(text):
    assert cql.to_text(cql.parse(text, COLUMNS)) == text


_values = st.text(st.characters(codec="utf-8", exclude_characters="'\"", exclude_categories=["Cs"]), max_size=12)
_filters = st.lists(st.builds(Filter, st.sampled_from(COLUMNS), st.sampled_from(["=", "!=", "<", ">", "<=", ">=", "LIKE", "RLIKE"]), _values), max_size=3)
_ranges = st.sampled_from([Range(), Range("X"), Range("chr3", 5), Range("7", None, 9), Range("Y", 2, 8)])
_sorts = st.lists(st.builds(Sort, st.sampled_from(COLUMNS), st.booleans()), max_size=3)


@settings(max_examples=200, deadline=None)
@given(_filters, _ranges, _sorts)
def test_parse_is_the_inverse_of_to_text(filters, found, sorts):
    q = Query(tuple(filters), found, tuple(sorts))
    assert cql.parse(cql.to_text(q), COLUMNS) == q


def test_equivalent():
    p = lambda t: cql.parse(t, COLUMNS)
    assert cql.equivalent(p("ref = A AND info:DP < 9"), p("info:DP < 9 AND ref = A")) and not cql.equivalent(p("ref = A"), p("ref = C"))
    assert cql.equivalent(p("ORDER BY ref"), p("order by ref ASC")) and not cql.equivalent(p("ORDER BY ref, alt"), p("ORDER BY alt, ref"))


def test_quotes():
    assert cql.quoted("it's") == '"it\'s"' and cql.quoted("G") in ("G", "'G'")
    with pytest.raises(cql.QueryError):
        cql.quoted("\"both' kinds")
