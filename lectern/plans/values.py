"""Fixed values of the read model, as its inputs need them."""

from __future__ import annotations

#: Departments of each college, exact names; every other department is Other.
DEPARTMENTS = {
    "Khoury": (
        "Computer Science",
        "Information Science",
        "Information Systems",
        "Computer & Informational Tech.",
        "Computer amp Informational Tech.",
        "Computer  Informational Tech.",
        "Computer Engineering",
        "Cybersecurity",
        "Data Science",
        "Computer Information Systm",
    ),
    "Engineering": (
        "Engineering",
        "Electrical Engineering",
        "Mechanical Engineering",
        "Civil Engineering",
        "Chemical Engineering",
        "Industrial Engineering",
        "Materials Engineering",
        "Engineering Technology",
        "Electronics",
        "Electrical & Computer Engr",
        "Mechanical & Industrial Eng",
        "Civil & Environmental Eng",
        "Bioengineering",
        "Industrial Technology",
    ),
    "Business": (
        "Business",
        "Business Administration",
        "Finance",
        "Finance & Insurance",
        "Accounting",
        "Accounting & Finance",
        "Marketing",
        "Management",
        "Entrepreneurship",
        "International Business",
        "Supply Chain Management",
        "Operations Management",
        "Managerial Science",
        "Organizational Behavior",
        "Organizational Leadership",
        "Human Resources Management",
        "Leadership",
    ),
    "Science": (
        "Mathematics",
        "Physics",
        "Chemistry",
        "Biology",
        "Biochemistry",
        "Environmental Science",
        "Environmental Studies",
        "Marine Sciences",
        "Marine Biology",
        "Microbiology",
        "Biotechnology",
        "Geology",
        "Earth Science",
        "Biomedical",
        "Science",
        "Math",
        "Behavioral Neuroscience",
    ),
    "CAMD": (
        "Art",
        "Art History",
        "Architecture",
        "Communication Studies",
        "Communication",
        "Communications",
        "Journalism",
        "Media",
        "Media Studies",
        "Graphic Design",
        "Design",
        "Music",
        "Music Technology",
        "Music Business",
        "Theater",
        "Game Design",
        "Fine Arts",
        "Visual Arts",
        "Cinema",
        "Photography",
        "Multimedia",
        "Creative Studies",
    ),
    "Health Sciences": (
        "Health Science",
        "Health Sciences",
        "Nursing",
        "Pharmacy",
        "Physical Therapy",
        "Speech & Hearing Sciences",
        "Speech Language Pathology",
        "Health Management",
        "Health  Physical Education",
        "Medicine",
        "Regulatory Affairs",
        "Counseling Psychology",
        "Applied Psychology",
    ),
    "CSSH": (
        "Political Science",
        "Economics",
        "History",
        "Psychology",
        "Sociology",
        "Philosophy",
        "English",
        "Writing",
        "Literature",
        "Linguistics",
        "Languages",
        "Modern Languages",
        "Spanish",
        "French",
        "Arabic",
        "Sign Language",
        "World Languages Center",
        "Criminal Justice",
        "Anthropology",
        "Human Services",
        "Religious Studies",
        "Judaic Studies",
        "International Studies",
        "International Affairs",
        "International Politics",
        "East Asian Studies",
        "Latin American Studies",
        "African-American Studies",
        "Women's Studies",
        "Women",
        "Social Science",
        "Public Policy",
        "Public Administration",
        "Urban Studies",
        "Humanities",
    ),
    "Professional Studies": (
        "Education",
        "Professional Studies",
        "Counseling & Educational Psych",
        "Counseling amp Educational Psych",
        "Counseling  Educational Psych",
    ),
    "Law": (
        "Law",
    ),
}
COLLEGE_OF = {d: c for c, ds in DEPARTMENTS.items() for d in ds}
OTHER = "Other"
#: Colleges whose people need five answers in all instead of a number from each source.
LENIENT = ("Law", "Professional Studies")

#: Starts of first cells of report rows that are no questions.
SKIPPED = (
    "evaluations summary",
    "all responses",
    "northeastern",
    "course reference",
    "enrollment",
    "completed",
    "answer counts",
    "strongly agree",
    "agree",
    "neutral",
    "disagree",
    "strongly positive",
    "positive",
    "negative",
    "almost always",
    "usually effective",
    "sometimes effective",
    "rarely effective",
    "never effective",
    "not applicable",
    "mean",
    "median",
    "std dev",
    "response rate",
    "general summary",
    "overall course summary",
    "instructor summary",
    "overall effectiveness summary",
    "materials summary",
    "all student responses",
    "eval #",
)

#: Order of grades.
GRADES = ("A+", "A", "A-", "B+", "B", "B-", "C+", "C", "C-", "D+", "D", "D-", "F", "W", "WF", "P", "NP", "I")
#: Texts that stand for no grade.
NO_GRADE = ("N/A", "Not sure yet", "Rather not say")

#: Known sources by key, with the id that scans filter by.
SOURCES = {
    "northeastern": (696, "Northeastern University"),
    "mit": (580, "Massachusetts Institute of Technology"),
    "harvard": (399, "Harvard University"),
    "bu": (107, "Boston University"),
    "bc": (103, "Boston College"),
    "tufts": (1040, "Tufts University"),
    "nyu": (675, "New York University"),
    "stanford": (953, "Stanford University"),
    "berkeley": (1072, "UC Berkeley"),
    "ucla": (1075, "UCLA"),
    "umass": (1513, "UMass Amherst"),
}
