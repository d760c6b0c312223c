"""Problem 1 on texts of a second writer, who shares no sentence, name list or number maker with the training texts."""

import random
import re

from pyspark.sql import functions as F

from auditloom.llm import pii

# values are marked as <kind>value</>; e email, p phone, i identity number, a address, n name
TEXTS = """
Hello team, <n>Margaret Osei</> from payroll will take over; her extension stays the same but the direct line is <p>+1 312 555 0148</>.
We could not reach <n>Tobias Lindgren</> yesterday, his mailbox <e>t.lindgren@harborline.example</> bounced twice.
The courier needs a signature at <a>48 Willowbrook Avenue</>, preferably before ten.
Kindly update the record: <n>Ines Carvalho</>, <a>17 Pinecrest Road, Millhaven</>, <p>(206) 555-0177</>.
Her passport number <i>X4821973</> expires in June, so the visa form must wait.
Machine Learning is taught on Tuesdays in room 14, Deep Learning on Thursdays.
The United Nations published a report; Saint Petersburg was mentioned on page 3.
Start the Java Virtual Machine with more memory and retry the Release Candidate.
There are 12 Main Results and 4 Open Problems in the appendix.
Version 10.2.33.4 replaced 10.2.33.1 after 30 days of testing.
Employee <n>Rajesh Venkataraman</> has SSN <i>512-44-9087</>, please store it encrypted.
My national insurance number is <i>AB 45 67 89 C</>, I started in March.
Send flowers to <a>1209 Magnolia Drive, Apt 5</> on Saturday.
Please phone <p>020 7946 0123</> or drop a note to <e>reception@oakridge-clinic.test</>.
Patient <n>Olivia Brandt</> moved to <a>Lindenstraße 44</> and asked for her results.
Build 20240312 finished in 512 seconds with 1024 tests and 3 retries.
Git tag 4.18.0 was signed by <n>Henrik Aalto</> <<e>henrik.aalto@buildworks.example</>>.
The order 4471-2209-18 left the warehouse, the parcel weighs 2.5 kg.
Tell <n>J. Whitfield</> that the meeting is moved; dial <p>+49 30 555 01 22</> to join.
The tenant, <n>Fiona McAllister</>, pays into the account since 2019.
IP 192.168.10.24 was blocked after 17 attempts on port 8443.
Write to <a>PO Box 7741</> if the shop is closed.
The invoice was approved by <n>Carlos Mendoza</> and paid on 2023-11-04 09:15:22.
Can you add <e>nadia_k@sundial.example</> and <e>omar.haddad@northpier.example</> to the list?
Call centre hours are 9 to 17; the hotline <p>1-800-555-0199</> is free.
On file: <n>Beatrice Fontaine</>, <e>b.fontaine@lumiere.example</>, <p>+33 1 55 55 01 43</>.
Professor <n>Samuel Adeyemi</> reviewed chapter 12 and the Final Draft.
His identity card <i>LN-558812</> was copied at the front desk.
The New Year sale starts Monday; Black Friday brought 4500 visitors.
Ship the replacement router to <a>305 Foxglove Lane, Ashbourne</>.
Trace 0x7ffee3a1 shows thread 1188 waiting 300 ms for lock 42.
Approved by manager <n>Wei Zhang</>; cost centre 4410, budget 12 000.
I live at <a>77b Harcourt Terrace</>, ring the upper bell.
Account holder <n>Ludmila Horvath</> gave tax id <i>921-70-4415</> over the counter.
Reading 448 112 093 kWh was entered twice by mistake for meter 7731.
Ask <n>Priscilla Nakamura</> whether the Blue Team or the Red Team presents first.
Contact: <e>support at brightpath dot example</>, answers within a day.
Please correct the spelling, it is <n>Dvořák, Milena</>, not Dvorak.
The Data Warehouse and the Message Broker restart at midnight.
Fax <p>(415) 555-0166</> no longer exists, use the form.
In Python 3 the Standard Library has a module for that.
Grandma's cottage is <a>5 Thistle Close, Ennerdale</>, no number on the door.
We hired <n>Jonas Petersen</> and <n>Amara Diallo</> last spring.
Row 118 of table 7 lists 3 200 000 units for region 12.
Reference 88-1024-7 belongs to shipment 5521 and not to 5522.
Insured under <i>JK112233D</> since 2011.
Our San Francisco office closes at noon, the Los Angeles one stays open.
<n>Gwendolyn Achterberg</> asked why the Access Review takes so long.
Her number is <p>312-555-0190</>, best after six.
The social security number <i>433 18 2290</> was redacted by hand.
Aadhaar <i>0423 7719 5560</> was shown at the gate.
Deliver to <n>Katarzyna Wolska</>, <a>Calle Almendro 21, Valdemar</>.
Page 404 Not Found appears when the Home Page is cached.
Mail <e>first.last+news@quietriver.example</> is an alias of the newsletter.
See you at Lake Garda or at Mount Rainier, whichever is drier.
The licence plate and the Serial Number 77-3412 are on the sticker.
Please thank <n>Declan O'Rourke</> for the photographs.
The voicemail of <p>+44 161 496 0733</> is full.
<n>Theresa Blackwood</> is the new landlord of <a>210 Orchard Street</>.
ISBN 978-0-306-40615-7 is out of print, 2nd edition follows.
Reset link was sent to <e>mwalker77@greenfield.example</> at 14:03.
Payroll lists <i>QQ 11 90 42 B</> and <i>CD773301A</> without a name.
Renew passport <i>K77120938</> before the flight, says the agency.
The voter gave <i>281-55-7712</>; the clerk compared it with the letter.
Nominee <n>Harriet Quist</> left her tax number <i>902-71-3345</> on the desk.
Reading 23 881 kWh in May, 24 102 kWh in June, 1 200 kWh were estimated.
Seats 114-22 to 114-30 are reserved, row 7 is empty.
Certificate 2024/118/77 replaces 2023/540/12.
Carry ID card <i>XX-204417</> at all times in the plant.
Emergency contact: <n>Stefano Ricci</>, brother, <p>+39 06 555 0123</>.
""".strip().split("\n")
_CODES = {"e": 0, "p": 1, "i": 2, "a": 3, "n": 4}


def _plain(marked):
    text, spans, at = "", [], 0
    for m in re.finditer(r"<([epian])>(.*?)</>", marked):
        text += marked[at : m.start()]
        spans.append((len(text), len(text) + len(m.group(2)), _CODES[m.group(1)]))
        text += m.group(2)
        at = m.end()
    return text + marked[at:], spans


def _chosen(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "record_id bigint, text string").select(F.lit("s").alias("source_table"), "record_id", F.lit("f").alias("field"), "text")
    return {r.record_id: [(s["start"], s["end"], s["kind"]) for s in r.spans] for r in pii.chosen(df).collect()}


def test_precision_and_recall_per_kind(spark):
    cases = [_plain(x) for x in TEXTS]
    got = _chosen(spark, [t for t, _ in cases])
    right, found, true = [0] * 5, [0] * 5, [0] * 5
    wrong = []
    for i, (t, truth) in enumerate(cases):
        for s in got.get(i, []):
            ok = pii.is_right(t, s, truth)
            found[s[2]] += 1
            right[s[2]] += ok
            if not ok:
                wrong.append((pii.KINDS[s[2]], t[s[0] : s[1]]))
        for s in truth:
            true[s[2]] += 1
            if not any(pii.is_right(t, x, [s]) for x in got.get(i, [])):
                wrong.append(("missed", t[s[0] : s[1]]))
    figures = {k: (round(right[i] / max(1, found[i]), 2), round(right[i] / true[i], 2), true[i]) for i, k in enumerate(pii.KINDS)}
    assert all(p >= 0.9 and r >= 0.9 for p, r, _ in figures.values()), (figures, wrong)


def test_candidates_imply_the_filter(spark):
    """Random strings of pieces from which candidates are made, with Unicode letters, digits, blanks, escapes and invisible characters."""
    rng = random.Random(12)
    pieces = ["A", "Ö", "Ž", "Д", "é", "b", "ß", "weg", "Street", "rue ", "bis ", "PO Box", "Str.", "12", "7", "٣", "555", "0123", ".", ". ", ",", ", ", " ", " ", "\t", "\n", "\\n", "\\u00e9", "​", "-", "'", "’", "/", "\\/", "(", ")", "+", "@", "＠", "%40", "(at)", "[AT]", " at ", " AT ", " dot ", "[dot]", "x.org", "ext", "q", "Ada", "Lovelace", "O’", "ab12", "QQ", "C-"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(2, 12))) for _ in range(60_000)]
    texts += ["send it to Österweg 12 today", "+1​415​555​0123", "A" + "b" * 200 + " Lovelace", "at " + "Q" + "u" * 300 + "weg 12", "mail joe at " + "h" * 150 + " dot org", "5551234", "12 boulevard Voltaire", "joe (AT) host (DOT) com", "É. Dupont", "Łukasz Dvořák"]
    have = [t for t in texts if pii.candidates(pii.unescape(t)[0])]
    assert len(have) > 5_000
    lost = spark.createDataFrame([(t,) for t in have], "t string").where(~F.rlike("t", F.lit(pii.PREFILTER))).collect()
    assert [r.t for r in lost] == []
    assert all(any(t == x for x in have) for t in texts[-10:])


def test_filter_and_generators_are_linear():
    import time

    for t in ("A" * 300_000, "A-" * 150_000, "Ab " * 100_000, "1 " * 150_000, "a@" * 100_000, "x'" * 150_000, " at a" * 60_000, "A. " * 100_000):
        began = time.time()
        pii.candidates(t)
        assert time.time() - began < 30, t[:6]
