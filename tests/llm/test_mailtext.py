from quarrybed.llm.mailtext import label_lines, mail_lines, new_text

MAILS = {
    "marked": (["Hi all,", "The report is ready for you.", "> 80% of the clusters are free, so carving takes time.", "Best regards,", "-- ", "Ann Larkelli", "Intake Officer", "Tel. +1 202 555 0170", "This message is confidential and meant only for the addressee. If you", "received it in error, please delete it.", "Bo Marsh said on 11/03/2021:", "> Where is it?", "> Bo"], None, [0, 1, 2]),
    "bottom": (["* Bo Marsh [2021-03-11 10:00]:", "| Where is the report now?", "| Bo", "It was sent to the lab yesterday.", "Thanks,", "Ann Larkelli"], None, [3]),
    "header": (["See the older message below.", "-----Original Message-----", "From: Bo Marsh <bo@x.test>", "Sent: 14 May 2020 06:45", "To: lab", "Subject: Report", "Where is the report now, please?"], None, [0]),
    "traps": (["From: that point on, the clock is wrong.", "Sent: no. Received: yes. Very odd.", "| col a | col b | as you asked", "On Monday the drive wrote:", "Original message headers are in the folder.", "* hash list first"], None, [0, 1, 2, 3, 4, 5]),
    "unmarked": (["It is done and filed.", "Regards,", "Ann Larkelli", "Where did the second drive go after the", "meeting in the basement?"], "Where did the second drive go\nafter the meeting in the basement?", [0]),
    "device": (["Gruß aus dem Labor, alles fertig.", "MfG", "Von meinem Mobilgerät gesendet"], None, [0]),
}


def test_new_lines(spark):
    rows = [(i, "\n".join(lines), f"<m{i}>", f"<p{i}>" if parent else None, False, "x") for i, (lines, parent, _) in enumerate(MAILS.values())]
    rows += [(100 + i, parent, f"<p{i}>", None, False, "x") for i, (_, parent, _) in enumerate(MAILS.values()) if parent]
    df = spark.createDataFrame(rows, "entry_id bigint, body_preview string, message_id string, in_reply_to string, body_truncated boolean, label string")
    got = {}
    for r in mail_lines(df, sender=None).where("label = 'new'").collect():
        got.setdefault(r.record_id, []).append(r.line_no)
    for i, (name, (_, _, want)) in enumerate(MAILS.items()):
        assert sorted(got.get(i, [])) == want, name


def test_edges(spark):
    schema = "entry_id bigint, body_preview string, message_id string, in_reply_to string, body_truncated boolean"
    df = spark.createDataFrame([(1, None, None, None, None), (2, "", "<a>", "<none>", None), (None, "Hello there, it works.", "<a>", "<a>", True), (4, "word and more text here.\n" * 3000, None, " ", False)], schema)
    rows = mail_lines(df, sender=None).collect()
    assert {r.record_id for r in rows} == {None, 4} and sum(r.record_id == 4 for r in rows) == 3001
    assert mail_lines(df.where("false"), sender=None).count() == 0
    assert {r.record_id: r.new_text for r in new_text(df.where("entry_id is null"), sender=None).collect()} == {None: "Hello there, it works."}


def test_the_senders_name_tells_whose_text_it_signs():
    lines = ["From: Bo Marsh <bo@x.test>", "Sent: 14 May 2020 06:45", "Subject: Report", "Where is the second drive now?", "Regards,", "Bo Marsh", "It went to the lab in the morning.", "Cheers", "Ann Larkelli"]
    assert [i for i, k in enumerate(label_lines("\n".join(lines), sender="Ann Larkelli <ann@x.test>")) if k == 0] == [6]
