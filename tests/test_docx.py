import zipfile

from folioflow.sources import docx

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:wps="urn:wps" xmlns:wpg="urn:wpg"'
P = lambda inner, props="": f"<w:p><w:pPr>{props}</w:pPr>{inner}</w:p>"
T = lambda t, props="": f"<w:r><w:rPr>{props}</w:rPr><w:t>{t}</w:t></w:r>"
BODY = (
    P(T("Title"), '<w:pStyle w:val="H"/>')
    + P(T("bold", "<w:b/>") + T(" x") + T("2", '<w:vertAlign w:val="superscript"/>'))
    + P(T("one"), '<w:numPr><w:ilvl w:val="1"/><w:numId w:val="5"/></w:numPr>')
    + P('<m:oMath><m:f><m:num><m:r><m:t>a</m:t></m:r></m:num><m:den><m:r><m:t>2</m:t></m:r></m:den></m:f></m:oMath>')
    + P('<w:r><w:br w:type="page"/><w:t>next</w:t></w:r>')
    + '<w:p><w:r><w:drawing><wp:extent cx="19050" cy="9525"/><a:blip r:embed="r1"/><a:blip r:embed="none"/></w:drawing></w:r></w:p>'
    + f'<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{P(T("c"))}</w:tc><w:tc>{P(T("d"))}</w:tc></w:tr></w:tbl>'
)
STYLES = '<w:style w:styleId="H"><w:name w:val="Mine"/><w:basedOn w:val="H2"/></w:style><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style>'
NUM = '<w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="1"><w:start w:val="3"/><w:numFmt w:val="lowerLetter"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="1"/><w:lvlOverride w:ilvl="1"><w:startOverride w:val="7"/></w:lvlOverride></w:num>'


def test_docx(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{BODY}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {NS}>{STYLES}</w:styles>")
        z.writestr("word/numbering.xml", f"<w:numbering {NS}>{NUM}</w:numbering>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="r1" Target="media/i.png"/></Relationships>')
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    rows = docx.read_docx(spark, str(tmp_path)).orderBy("block_ord").collect()
    assert [(r.type, r.level, r.text, r.page) for r in rows] == [("section_heading", 2, "Title", 1), ("paragraph", None, "bold x2", 1), ("list_item", 1, "one", 1), ("equation", None, "", 1), ("paragraph", None, "next", 2), ("figure", None, None, 2), ("table", None, "c | d", 2)]
    assert rows[1].html == "<strong>bold</strong> x<sup>2</sup>"
    assert (rows[2].num_fmt, rows[2].start) == ("lowerLetter", 7)
    assert "<mfrac><mrow><mi>a</mi></mrow><mrow><mn>2</mn></mrow></mfrac>" in rows[3].html
    assert (rows[5].src, rows[5].width, rows[5].height) == ("media/i.png", 2.0, 1.0)
    assert (rows[6].n_rows, rows[6].columns) == (1, 3)
    m = docx.import_metrics(docx.read_docx(spark, str(tmp_path))).first()
    assert (m.blocks, m.headings, m.list_items, m.tables, m.figures, m.math, m.pages) == (7, 1, 1, 1, 1, 1, 2)


def picture(rid, size=""):
    return f'<pic:pic><pic:blipFill><a:blip r:embed="{rid}"/></pic:blipFill><pic:spPr><a:xfrm>{size}</a:xfrm></pic:spPr></pic:pic>'


def box(*texts):
    return "<wps:txbx><w:txbxContent>" + "".join(P(T(t)) for t in texts) + "</w:txbxContent></wps:txbx>"


def test_groups_and_text_boxes(spark, tmp_path):
    """A group of two pictures and boxes, an anchored picture, a box in a box; what a fallback repeats is not read."""
    group = f'<wp:anchor><wp:positionH><wp:align>left</wp:align></wp:positionH><wp:extent cx="9525000" cy="4762500"/><wpg:wgp>{picture("r1", """<a:ext cx="952500" cy="476250"/>""")}{picture("r2")}{box("Figure 3 two parts")}{box("axis x")}{box("axis x")}</wpg:wgp></wp:anchor>'
    long = "A long remark. " * 12
    boxed = f'<mc:AlternateContent><mc:Choice><w:drawing><wp:inline>{box("Σχόλιο: short", "and more")}</wp:inline></w:drawing></mc:Choice><mc:Fallback><w:pict>{box("Σχόλιο: other")}</w:pict></mc:Fallback></mc:AlternateContent>'
    nested = f"<w:drawing><wp:inline><wps:txbx><w:txbxContent>{P(T(long) + f'<w:r><w:drawing>{box(chr(72) + chr(105) * 200)}</w:drawing></w:r>')}</w:txbxContent></wps:txbx></wp:inline></w:drawing>"
    body = f"<w:p><w:r><w:t>Text.</w:t></w:r><w:r><w:drawing>{group}</w:drawing></w:r></w:p><w:p><w:r>{boxed}</w:r></w:p><w:p><w:r>{nested}</w:r></w:p>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="r1" Target="m/1.png"/><Relationship Id="r2" Target="m/2.png"/></Relationships>')
    rows = docx.read_docx(spark, str(tmp_path)).orderBy("block_ord").collect()
    assert [(r.type, r.text) for r in rows] == [("paragraph", "Text."), ("figure", None), ("figure", None), ("textbox", "Σχόλιο: short and more"), ("textbox", long.strip()), ("textbox", "H" + "i" * 200)]
    assert [(r.src, r.width, r.height, r.placement) for r in rows[1:3]] == [("m/1.png", 100.0, 50.0, "float-left"), ("m/2.png", 1000.0, 500.0, "float-left")]
    assert [(r.caption, r.text_labels) for r in rows[1:3]] == [("Figure 3 two parts", ["axis x"]), (None, [])]
    assert rows[3].html == "Σχόλιο: short<br>and more" and rows[3].label == "Σχόλιο:"
