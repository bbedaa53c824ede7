"""The record builder on hand-written sections, and its state over batches."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators import degrees, roles


def read(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    return roles.roles(roles.section_of(rows, "experience")).orderBy("doc_id", "rec").collect()


DATED = """Jane Roe
SUMMARY
Ten years 2001 - 2011 of work.
PROFESSIONAL EXPERIENCE
Northwind Communications January 2021 to September 2022
Irving, TX
Technology Lead| Platform & Devices Project
Built responsive interfaces using Angular.
Fabrikam August 2019 to January 2021
Malvern, PA
Technology Lead| Participant Experience Project
Architected Spring Boot services.
Contoso Power, Gurugram June 2013 to September 2014
Haryana, India
Jr. Java Back-End Engineer | In-House Project | Java payment gateway
Environment: Java, J2EE, Spring, java
EDUCATION
Master of Science 2010 - 2012
"""


def test_dated_lines_take_titles_and_places_from_the_lines_ahead(spark):
    got = read(spark, DATED)
    assert [(r.company, r.location, r.duration) for r in got] == [
        ("Northwind Communications", "Irving, TX", "January 2021 to September 2022"), ("Fabrikam", "Malvern, PA", "August 2019 to January 2021"),
        ("Contoso Power", "Gurugram", "June 2013 to September 2014")]
    assert [r.title for r in got] == ["Technology Lead| Platform & Devices Project", "Technology Lead| Participant Experience Project", "Jr. Java Back-End Engineer | In-House Project | Java payment gateway"]
    assert got[2].technologies == ["Java", "J2EE", "Spring"] and got[2]["items"] == [] and got[0]["items"] == ["Built responsive interfaces using Angular."]


def test_wrapped_items_stay_with_their_role(spark):
    got = read(spark, """EXPERIENCE
Staff Engineer — AI/ML | Adatum India July 2025 – Present
• Mentor 8+ engineers on good practice
across squads.
Associate Engineer — AI/ML | Adatum India Jan 2024 – July 2025
• Built a system that reads documents.
""")
    assert [(r.title, r.company) for r in got] == [("Staff Engineer — AI/ML", "Adatum India"), ("Associate Engineer — AI/ML", "Adatum India")]
    assert got[0]["items"] == ["Mentor 8+ engineers on good practice across squads."] and got[1]["items"] == ["Built a system that reads documents."]


@pytest.mark.parametrize(("line", "title", "company", "place"), [
    ("Staff Engineer — AI/ML | Adatum India July 2025 – Present", "Staff Engineer — AI/ML", "Adatum India", ""),
    ("AI/MLDeveloper|Tailspin Technologies Mar 2026—Present", "AI/ML Developer", "Tailspin Technologies", ""),
    ("Data Analyst at Litware, Pune 2019 - 2020", "Data Analyst", "Litware", "Pune"),
    ("Wingtip, Austin, TX (Aug 2025 to April 2026) | Senior Engineer | Desk", "Senior Engineer", "Wingtip", "Austin, TX"),
    ("Proseware, Inc 2018 - 2019 Developer", "Developer", "Proseware, Inc", ""),
])
def test_headers(line, title, company, place):
    got = roles.header(line, roles._DATES.search(line))
    assert (got.title, got.company, got.location) == (title, company, place)


def test_titles_above_dates_gaps_and_repeats(spark):
    got = read(spark, """WORK EXPERIENCE
Data Engineer
Litware, Pune Jan 2020 - Mar 2021
- Moved tables
Gap Period 2018 - 2019
Litware Inc January 2020 to March 2021
- One
- Two
Total experience: 5 years
Coho 2016 - 2017
Technical Lead
""")
    assert [(r.rec, r.title, r.company, r["items"]) for r in got] == [(1, "Data Engineer", "Litware Inc", ["One", "Two"]), (2, "Technical Lead", "Coho", [])]


def test_documents_without_a_dated_section_are_read_whole(spark):
    got = read(spark, "EXPERIENCE\nnone\nPROJECTS\nDeveloper | Firm 2019 - 2020\n- Work", "", "no dates at all\nhere")
    assert [(r.doc_id, r.company) for r in got] == [(0, "Firm")]


def test_state_is_carried_over_batches(spark):
    """Batches of two rows give what one batch gives."""
    long = "EXPERIENCE\n" + "\n".join(f"Lead {i} | Firm {i} Jan {2000 + i % 20} - Mar {2001 + i % 20}\n• did {i}\nand more\n\n" for i in range(60))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    whole, before = read(spark, long, DATED), spark.conf.get(size)
    try:
        spark.conf.set(size, "2")
        assert read(spark, long, DATED) == whole and len(whole) == 63
    finally:
        spark.conf.set(size, before)


def test_look_ahead_ends_after_three_lines(spark):
    got = read(spark, "EXPERIENCE\nFirm 2019 - 2020\n\n\n\nDeveloper of things\n- Work", "EXPERIENCE\nFirm 2019 - 2020\n\n\nDeveloper\n- Work")
    assert got[1].title == "Developer" and got[1]["items"] == ["Work"]
    # four lines on it is no look-ahead any more, but the first detail, which is promoted
    assert got[0].title == "Developer of things" and got[0]["items"] == ["Work"]


@pytest.mark.parametrize(("text", "bad"), [
    ("Senior Developer", False), ("Austin, TX", True), ("TX", True), ("across squads.", True), ("Built a thing that has many more words in it", True), ("Jr. Java Engineer", False), ("", True), ("Led teams.", True), ("Sr. Architect.", False),
])
def test_titles(text, bad):
    assert roles.no_title(text) is bad


def test_headings(spark):
    lines = ["EXPERIENCE", "Work Experience:", "Experience in software firms", "Experience of ten long years in software", "Skills, tools", "", "Languages & Frameworks: Java, Go, Rust, C"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [r.k for r in df.select(roles.heading_of(F.col("line")).alias("k")).collect()] == [roles._known(roles.heading_key(x)) for x in lines]


def lines_of(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))


CLEAN = """EDUCATION
Master of Technology(M.Tech) in Infrastructure Design Management|CGPA:9.09/10 Aug 2022—May 2024
Indian Institute of Technology(IIT) Kharagpur
Bachelor of Technology(B.Tech) in Civil Engineering|CGPA:8.16/10 Aug 2017—May 2021
Government College of Engineering Amravati
"""
MASHED = """EDUCATION
Bachelorof Technology(B.Tech) in Civil Engineering|CGPA:8.16/10 Aug 2017—May 2021
Government Collegeof Engineering Amravati
Masterof Technology(M.Tech) in Infrastructure Design Management|CGPA:9.09/10 Aug 2022—May 2024
Indian Instituteof Technology(IIT) Kharagpur
"""


def test_education_of_clean_and_mashed_lines(spark):
    got = degrees.education(lines_of(spark, CLEAN, MASHED)).orderBy("doc_id", "rec").collect()
    clean, mashed = ([r for r in got if r.doc_id == i] for i in (0, 1))
    assert [(r.institution, r.year, r.grade) for r in clean] == [
        ("Indian Institute of Technology (IIT) Kharagpur", "Aug 2022—May 2024", "9.09/10"), ("Government College of Engineering Amravati", "Aug 2017—May 2021", "8.16/10")]
    assert [r.degree for r in clean] == ["Master of Technology (M.Tech) in Infrastructure Design Management", "Bachelor of Technology (B.Tech) in Civil Engineering"]
    assert [tuple(r)[2:6] for r in mashed] == [tuple(r)[2:6] for r in reversed(clean)]


def test_education_elsewhere_details_and_repeats(spark):
    got = degrees.education(lines_of(spark, """Bachelors @ Hill University 2011
EDUCATION
Diploma in Sales
Hill School
2009
GPA: 3.5/4
- Prize for Latin
preferred: remote
Diploma in Sales
Hill School
SKILLS
Master of Arts
""", "Master of Science, River University 2004")).orderBy("doc_id", "rec").collect()
    assert [tuple(r)[:6] for r in got[:2]] == [(0, 1, "Diploma in Sales", "Hill School", "2009", "3.5/4"), (0, 2, "Bachelors", "Hill University 2011", "2011", "")]
    assert len(got) == 3 and got[0].details == ["Prize for Latin"] and got[2].year == "2004" and "River University" in got[2].institution


def test_projects(spark):
    text = """PROJECTS
RetrieveIQ – Search over papers (Python, Redis)
• Reads papers
and ranks them.
PredictAI–Loan scores
- Scored loans with care.
Held up well in use. StoreKit - Small shop
- Sold things

Plain Title
- Work
SKILLS
Not – A project
"""
    got = degrees.projects(lines_of(spark, text, "no section")).orderBy("rec").collect()
    assert [(r.name, r.technologies, r["items"]) for r in got] == [
        ("RetrieveIQ – Search over papers", ["Python", "Redis"], ["Reads papers and ranks them."]), ("PredictAI–Loan scores", [], ["Scored loans with care.", "Held up well in use."]),
        ("StoreKit - Small shop", [], ["Sold things"]), ("Plain Title", [], ["Work"])]


def test_numbers_of_diplomas_are_no_years(spark):
    got = degrees.education(lines_of(spark, """EDUCATION
Diploma No 1925
College of Trade
in 1935
Diploma No. 2004, 2009
""")).orderBy("rec").collect()
    assert [(r.degree, r.year, r.details) for r in got] == [("Diploma No 1925", "1935", []), ("Diploma No. 2004", "2009", [])]


ODD = """٢٠١٩ Skills of mine
Ex-perience
Lead 1 | Firm 1 Jan 2019 – Mar 2020
• did one
and more
E-nvironment: Java, Go
Gap  Period 2018 - 2019
　● Firm 2, Pune\x0b2019 - 2020
Lead 3 at Firm 3 ٢٠١٩ - ٢٠٢٠
Total experience: 5 years
WORK EXPERIENCE
Developer
Firm 4 2016/2017
- Work
SKİLLS
PROJECTS
Lead 9 | Firm 9 Jan 2001 - Mar 2002"""


def test_rows_of_lines_give_what_sorted_lines_give_without_a_shuffle(spark):
    """Whole documents, with nulls, need no window, shuffle or sort; dates out of the section, and none in it, are told apart."""
    texts = [DATED, ODD, "EXPERIENCE\nnone\nPROJECTS\nDeveloper | Firm 2019 - 2020\n- Work", "", "Firm 2019 - 2020\n- Work\nEXPERIENCE", ODD.replace("Ex-perience\n", "")]
    docs = spark.createDataFrame([(i, [x or None for x in t.split("\n")]) for i, t in enumerate(texts)] + [(99, None), (None, ["Firm 2019 - 2020", "Lead"])], "doc_id long, lines array<string>")
    want = roles.roles(roles.section_of(docs.select("doc_id", F.posexplode("lines").alias("ln", "line")), "experience"))
    got = roles.section_roles(docs, "experience")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 8
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Window", "Exchange", "Sort"))


def test_role_records_marks_sections_as_it_reads(spark, sf_dir):
    """Neither windows over lines nor a line a row: both cost more than all else."""
    from paperloom import catalog

    plan = catalog.QUERIES["role_records"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan


def test_marks_leave_no_line_out():
    import pyarrow as pa

    lines = ["• built 12 things", "jan 2020 TO mar 2021", "1999\t/ 2001", "٢٠١٩ - ٢٠٢٠", " E-X perience", "ex-perience", "gap  period", "ſkills", None]
    assert roles.marks(pa.array(lines)) == ([False, True, True, True, False, False, False, True, True], [False, False, False, True, False, True, True, True, True])
