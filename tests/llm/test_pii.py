import pytest

from quarrybed.llm import pii

LEX = [("Anwen", "given"), ("Will", "given"), ("Mark", "given"), ("Morelli", "family"), ("Fennelli", "family"), ("Larkelli", "family"), ("Briselli", "family"), ("Day", "family"), ("Marsh", "family"), ("O'Tarrin", "family")]
L = pii.Lexicon.of(LEX)


def found(text, **k):
    return [(kind, text[a:b]) for a, b, kind, _ in pii.find_pii(text, L, **k)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("write to a.b+c@x-y.example.", [("email", "a.b+c@x-y.example")]),
        ("From: Anwen Morelli [mailto:anwen@x.test]", [("person_name", "Anwen Morelli"), ("email", "anwen@x.test")]),
        ("reach anwen (dot) m (at) mail (dot) x (dot) test", [("email", "anwen (dot) m (at) mail (dot) x (dot) test")]),
        ("came in with id <31230863.605d0a@mx.relay>.", []),
        ("Use the tag @evidence-059", []),
        ("Call +49 (0)30 23125 048 or (312) 555-0116.", [("phone", "+49 (0)30 23125 048"), ("phone", "(312) 555-0116")]),
        ("Tel. +1-415-555-0107 ext. 189", [("phone", "+1-415-555-0107 ext. 189")]),
        ("020 7946 0159 / 030/23125-130 / 01 99 00 23 59 / 646.555.0194", [("phone", "020 7946 0159"), ("phone", "030/23125-130"), ("phone", "01 99 00 23 59"), ("phone", "646.555.0194")]),
        ("re ((202) 555-0159)", [("phone", "(202) 555-0159")]),
        ("Ticket 4500 8659 20 on 2023-04-07, 13.04.2020, build 10.0.68191.027, ip 10.75.20.7", []),
        ("SSN#954-45-2843 lies", [("id_number", "954-45-2843")]),
        ("steht als DNI der Wert 00034140-Y.", [("id_number", "00034140-Y")]),
        ("social security\n: number#940 28 5848 lies", [("id_number", "940 28 5848")]),
        ("NI number QQ 87 10 79 C, passport X7241090, Ausweisnummer L025V0024", [("id_number", "QQ 87 10 79 C"), ("id_number", "X7241090"), ("id_number", "L025V0024")]),
        ("Exhibit 20-086-574, registered under number HG 2210", []),
        ("81A Pennywick Road | 40217 Osterby", [("street_address", "81A Pennywick Road")]),
        ("9 bis, rue de la Tannerie, Apt 3", [("street_address", "9 bis, rue de la Tannerie")]),
        ("Ostertorstr. 24 and Am Alten Speicher 118", [("street_address", "Ostertorstr. 24"), ("street_address", "Am Alten Speicher 118")]),
        ("Calle de los Olmos Viejos 169", [("street_address", "Calle de los Olmos Viejos 169")]),
        ("signed for by ANWEN MORELLI", [("person_name", "ANWEN MORELLI")]),
        ("call Morelli, Anwen at noon", [("person_name", "Morelli, Anwen")]),
        ("Dr. X. Larkelli and Zelda T. Quenelli spoke", [("person_name", "X. Larkelli"), ("person_name", "Zelda T. Quenelli")]),
        ("Will Day 2 be enough for the marsh survey?", []),
        ("Grace period ends on Day 9", []),
        ("Tessera Freight and Holmgrund Archiv", []),
        ("Best regards", []),
    ],
)
def test_values(text, want):
    assert found(text) == want


def test_validators():
    assert pii.luhn("79927398713") and not pii.luhn("79927398710") and not pii.luhn("")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    assert pii.mod23("12345678Z") and not pii.mod23("12345678A")
    assert pii.check731("L898902C36") and pii.nino("AB123456C") and not pii.nino("QQ123456C")


def test_cut_values_do_not_count_but_are_replaced():
    text = "write to anwen@x.test"
    assert found(text, cut=True) == [] and found(text) == [("email", "anwen@x.test")]


def test_known_by_the_headers():
    assert found("Zelda Größl", around="z.groessl@x.test") == [("person_name", "Zelda Größl")] and found("Zelda Größl went") == []


def test_frames(spark):
    rows = [(1, "a@x.test and a@x.test", None, "h", 9), (2, None, "", None, 9), (3, "   ", "call +1 202 555 0170", "", 9), (None, "b@x.test", "x", "", 9), (5, "y " * 60_000 + "c@x.test", "z", "", 9)]
    df = spark.createDataFrame(rows, "id bigint, body string, subject string, head string, record_id int")
    got = sorted((str(r.record_id), r.field_name, r.pii_type, r.pii_value) for r in pii.detect_pii(df, "id", ["body", "subject"], LEX, ["head"]).collect())
    assert got == [("1", "body", "email", "a@x.test")] * 2 + [("3", "subject", "phone", "+1 202 555 0170"), ("5", "body", "email", "c@x.test"), ("None", "body", "email", "b@x.test")]
    red = {r.id: (r.body_redacted, r.subject_redacted) for r in pii.redact_pii(df, "id", ["body", "subject"], LEX).collect()}
    assert red[1] == ("[EMAIL] and [EMAIL]", None) and red[2] == (None, "") and red[3] == ("   ", "call [PHONE]") and red[5][0].endswith("y [EMAIL]")
    assert pii.detect_pii(df.where("false"), "id", ["body"], LEX).count() == 0


def test_checksums_confirm():
    # a strong checksum suffices by itself; one that fails does not, and needs the label
    assert found("See 12345678Z there") == [("id_number", "12345678Z")] and found("See 12345678A there") == []
    assert found("case 12345678Z there") == []
    assert found("DNI 12345678A there") == [("id_number", "12345678A")]
    assert found("pay to DE89 3704 0044 0532 0130 00 soon") == [("bank_account", "DE89 3704 0044 0532 0130 00")]
    assert "bank_account" not in dict(found("pay to DE88 3704 0044 0532 0130 00 soon"))
    assert found("charged 4111 1111 1111 1111 twice") == [("payment_card", "4111 1111 1111 1111")] and found("charged 4111 1111 1111 1112 twice") == []
    assert found("number 529.982.247-25 there") == [("id_number", "529.982.247-25")] and found("number 529.982.247-26 there") == []
    assert pii.redact("to DE89370400440532013000.", pii.find_pii("to DE89370400440532013000.", L)) == "to [BANK_ACCOUNT]."
