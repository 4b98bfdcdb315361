"""Part trees against the standard library's reading of the same messages."""

import base64
import email
import quopri

from intakeloom.operators import mime

PDF = base64.b64encode(b"%PDF-1.4 " + bytes(range(256))).decode()


def attached(name, body=PDF, encoding="base64", kind="application/pdf"):
    return f"Content-Type: {kind}\nContent-Transfer-Encoding: {encoding}\nContent-Disposition: attachment; {name}\n\n{body}\n"


def mixed(boundary, *parts, head="From: a@example.com\n", before="", after=""):
    lines = "".join(f"--{boundary}\n{part}" for part in parts)
    return f'{head}Content-Type: multipart/mixed; boundary="{boundary}"\n\n{before}{lines}--{boundary}--\n{after}'


PLAIN = "Content-Type: text/plain\n\nDear desk\n"
MESSAGES = {
    "no headers at all": "Hello there,\n\nno headers: here\n",
    "headers only": "Subject: x\nContent-Type: text/html",
    "single part": "From: a@example.com\n" + attached('filename="scan 1.pdf"'),
    "blank in boundary": mixed("b c", PLAIN, attached("filename=x.pdf")),
    "signs in boundary": mixed("=_[a](b)+?'./:,\\E", PLAIN, attached("filename=x.pdf")),
    "nested": mixed(
        "out",
        'Content-Type: multipart/alternative;\n boundary=in\n\npre\n--in\n\nplain\n--in\nContent-Type: text/html\n\n<p>x</p>\n--in--\nend\n',
        attached("filename=a.pdf"),
    ),
    "boundary starts like another": mixed("b", 'Content-Type: multipart/mixed; boundary="b2"\n\n--b2\n\none\n--b2\n\ntwo\n--b2--\n', PLAIN),
    "prologue, epilogue": mixed("x", PLAIN, before="to be\n\nignored\n", after="\nend\n--x\nContent-Type: text/plain\n\nno part\n"),
    "declared in a text": mixed("x", 'Content-Type: text/plain\n\nboundary="y"\n--y\nContent-Type: a/b\n\n--xx\n--x y\n', PLAIN),
    "never closed": 'Content-Type: multipart/mixed; boundary=x\n\n--x\n\none\n--x\n\ntwo\n',
    "never opened": 'Content-Type: multipart/mixed; boundary="x"\n\nno part here\n',
    "no boundary": "Content-Type: multipart/mixed\n\n--x\n\none\n--x--\n",
    "trailing blanks": 'Content-Type: multipart/mixed; boundary="x "; charset=a\n\n--x \t\n\none\n--x-- \nend',
    "quoted-printable": mixed("x", attached("filename=x.pdf", quopri.encodestring(bytes(range(1, 256))).decode() + "a =3D b=\n c=zz  \nend", "quoted-printable")),
    "RFC 2231": mixed("x", attached("filename*=UTF-8''na%C3%AFve%20%22x%22.pdf"), attached("filename*=iso-8859-1'de'%FCber.pdf")),
    "in pieces": mixed("x", attached('filename*1="b; c.pdf"; filename*0="a "'), attached("filename*0*=utf-8''%C3%A9; filename*1=x.pdf")),
    "name of the type": mixed("x", attached("x=y", kind='application/x-pdf; name="n.pdf"'), attached('filename="a\\"b.pdf"')),
    "forwarded": mixed("x", "Content-Type: message/rfc822\n\nSubject: inner\n" + attached("filename=f.pdf"), PLAIN),
    "digest": 'Content-Type: multipart/digest; boundary=d\n\n--d\n\nSubject: one\n\ntext\n--d\nContent-Type: text/plain\n\nx\n--d--\n',
    "folded": "Content-Type:\n text/html;\n\tcharset=x\nContent-Transfer-Encoding: base64\n\nZm9v\nYmFy\n",
    "odd types": mixed("x", "Content-Type: pdf\n\na\n", "content-TYPE: Text/HTML ; x\n\nb\n", "Content-Type: a/b/c\n\nc\n", "no header\nbut a body\n", ": x\n\nd\n"),
    "line ends": mixed("x", PLAIN, attached("filename=x.pdf")).replace("\n", "\r\n"),
    "deep": mixed("a", mixed("b", mixed("c", mixed("d", mixed("e", PLAIN, head=""), head=""), head=""), head="")),
}


def walked(text):
    out = []
    for k, part in enumerate(email.message_from_string(text.replace("\r\n", "\n")).walk()):
        payload = part.get_payload(decode=True)
        out.append((k, part.get_content_type(), part.get_filename(), None if payload is None else payload))
    return out


def test_part_trees(spark):
    frame = spark.createDataFrame(list(MESSAGES.items()), "doc_id string, text string")
    got = {}
    for row in mime.message_parts(frame).collect():
        assert not row.uncut
        got.setdefault(row.doc_id, []).append((row.part_no, row.content_type, row.filename, row.payload and bytes(row.payload)))
    for name, text in MESSAGES.items():
        wanted = [(k, kind, file, payload or None) for k, kind, file, payload in walked(text)]
        found = [(k, kind, file, payload or None) for k, kind, file, payload in sorted(got[name])]
        assert found == wanted, name


def test_levels_and_nothing(spark):
    frame = spark.createDataFrame([(1, MESSAGES["deep"]), (2, None), (3, "")], "doc_id int, text string")
    rows = mime.message_parts(frame, levels=2).collect()
    assert [(r.part_no, r.uncut) for r in rows if r.doc_id == 1] == [(0, False), (1, False), (2, True)]
    assert [r.doc_id for r in rows if r.doc_id != 1] == [3]
    assert [r.content_type for r in rows if r.doc_id == 3] == ["text/plain"]


def test_attachments(spark):
    frame = spark.createDataFrame([(k, f"in/{k}.eml", text) for k, text in MESSAGES.items()], "doc_id string, source string, text string")
    got = {}
    for row in mime.pdf_attachments(frame).collect():
        got.setdefault(row.doc_id, []).append((row.attachment_name, bytes(row.payload)))
    for name, text in MESSAGES.items():
        wanted = []
        for part in email.message_from_string(text.replace("\r\n", "\n")).walk():
            if part.get_content_maintype() == "application" and "pdf" in part.get_content_type():
                if "attachment" in part.get("Content-Disposition", "") and part.get_filename():
                    wanted.append((f"{name}_{part.get_filename()}", part.get_payload(decode=True)))
        assert got.get(name, []) == wanted, name
