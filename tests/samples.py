"""Invented documents with the traits the rules react to."""

PLAIN_MAIL = """From: ann.lee@northwind-labs.com
To: helpdesk@orbit-hosting.com
Subject: URGENT: portal unreachable
Date: Tue, 13 Feb 2024 09:10:00 +0100

  Dear team,

the portal is down, this is critical. We lose $12,500 per hour.
Invoice 2024-17 and reference 77 are affected, reply by 02/14/2024 or 2024-02-15.
We need information and support.

Regards,
Ann Lee  \t
(555) 222-3333, again (555) 222-3333
bob.ray@northwind-labs.com
"""

MULTIPART = (
    'Content-Type: multipart/mixed; boundary="==outer=="\n'
    "From: kim@tender-office.org\nTo: sales@deskworks.com\nSubject: Quote for chairs\n\n"
    "--==outer==\nContent-Type: multipart/alternative; boundary=inner1\n\n"
    "--inner1\nContent-Type: text/plain\n\nDear sales, please quote.\n"
    "--inner1\nContent-Type: text/html\n\n<p>Dear sales</p>\n--inner1--\n"
    "--==outer==\nContent-Type: application/pdf\nContent-Transfer-Encoding: base64\n"
    'Content-Disposition: attachment;\n\tfilename="list of chairs.pdf"\n\n'
    "JVBERi0x\nLjQgaGVsbG8=\n"
    "--==outer==\nContent-Type: application/pdf\nContent-Disposition: inline; filename=x.pdf\n\n"
    "not attached\n--==outer==--\n"
)

INVOICE = """{"invoice": {
  "header": {"invoice_number": "N-1", "invoice_date": "2024-03-01", "due_date": "2024-03-31"},
  "vendor": {"company_name": "Deskworks", "contact": {"phone": "+1-555-000-1111", "email": "b@d.com"}},
  "customer": {"company_name": "Northwind", "contact_person": "Ann Lee", "contact": {"email": "a@n.com"}},
  "line_items": [{"item_id": "C1", "description": "chair", "quantity": 4, "unit_price": 99.5, "total_price": 398.0},
                 {"item_id": "C2", "quantity": 1}],
  "summary": {"total_amount": 478.25}}}"""
