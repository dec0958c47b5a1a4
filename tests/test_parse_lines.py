"""Lines of triples are read in one pass: parts are cut at brackets and quotation marks as the pattern's groups say."""

import re

from hoopframe import schema
from hoopframe.sources import readers


def test_cuts_equal_the_groups_of_the_pattern(spark):
    lines = [
        "<s> <p> <o> .", ' <s>\t<p>  <o>. ', '<s> <p> "x" .', '<s> <p> "x"@en-GB .', '<s> <p> "1"^^<int> .', '<s> <p> "a \\"b\\" <c> \\\\ \\n"^^<t> .', '<s> <p> "x"^^<a"b> .', '<s> <p> "<o>" .',
        '<s<t> <p<q> <o"x<y> .', '<s> <p> "" .', "<a> <b> .", "<s> <p> x .", '<s> <p> "x .', "<s> <p> <o>", "", "  ",
    ]
    got = {r.value: r for r in readers.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert set(got) == {x for x in lines if x.strip(" ")}
    for line, r in got.items():
        m = re.match(schema.TRIPLE, line.strip(" "))
        if not m:
            assert r[1:] == (None,) * 5, line
            continue
        iri = m[3] is not None
        text = m[3] if iri else m[4].replace('\\"', '"').replace("\\n", "\n").replace("\\\\", "\\")
        assert r[1:] == (m[1], m[2], text, "iri" if iri else "literal", m[5]), line
