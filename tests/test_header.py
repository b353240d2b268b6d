import warnings

import pytest

from tallyfold.errors import HeaderError
from tallyfold.sources.header import Column, parse_cell, parse_header, schema_of, sniff, split_line
from tallyfold.types import Kind


@pytest.mark.parametrize(
    ("cell", "column"),
    [
        ("id (N) (P)", Column("id", Kind.INT, True)),
        ("id (N)(P) ", Column("id", Kind.INT, True)),
        ("  amount (N)   ", Column("amount", Kind.INT)),
        ("made (D)", Column("made", Kind.DATETIME)),
        ("note (T) ", Column("note", Kind.STRING)),
        ("size (cm) (T)", Column("size (cm)", Kind.STRING)),
        ("two words (T)", Column("two words", Kind.STRING)),
    ],
)
def test_cells(cell, column):
    assert parse_cell(cell) == column


def test_a_missing_tag_is_text_with_a_warning():
    with pytest.warns(UserWarning, match="no type tag"):
        assert parse_cell("plain").kind is Kind.STRING


@pytest.mark.parametrize("line", ["", "  \n", "a (N),,b (T)", "(N)", "a (N),A (T)"])
def test_bad_headers(line):
    with warnings.catch_warnings(), pytest.raises(HeaderError):
        warnings.simplefilter("ignore")
        parse_header(line)


def test_quotes_commas_and_line_ends():
    assert [c.name for c in parse_header('"a, b (T)","say ""x"" (T)",c (N)\r\n')] == ["a, b", 'say "x"', "c"]
    assert split_line('1,"2,3",\n') == ["1", "2,3", ""]


def test_numbers_are_told_apart_by_any_sampled_row():
    columns = parse_header("a (N),b (N),c (N),d (N),e (T)")
    found = sniff(columns, [("1", "2", "3000000000", "", "9.5"), ("2", "2.5", "1", None, "x"), ("1e3", "7", "2", "", "")])
    assert [(c.kind, c.wide) for c in found] == [
        (Kind.FLOAT, False), (Kind.FLOAT, False), (Kind.INT, True), (Kind.INT, False), (Kind.STRING, False)
    ]
    assert [f.dataType.simpleString() for f in schema_of(found)] == ["double", "double", "bigint", "int", "string"]


def test_keys_are_in_the_schema():
    assert schema_of(parse_header("id (N) (P),x (T)"))["id"].metadata == {"pk": True}
