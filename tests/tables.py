"""Small tables of our own whose profile, issues and score are known by hand."""

CLEAN = """plant_id,label,grower_email,potted_date,weeks,height_cm,leaf_count,house
P-01,Basil,anke@beds.example,2024-03-01,12,31.5,40,North
P-02,Thyme,bilal@beds.example,2024-03-04,15,18.0,55,South
P-03,Sage,carla@beds.example,2024-03-09,11,27.2,33,East
P-04,Mint,deniz@beds.example,2024-03-15,14,35.8,48,East
P-05,Dill,edda@beds.example,2024-03-21,10,40.1,29,North
P-06,Chive,fritz@beds.example,2024-04-02,13,22.4,61,West
P-07,Lovage,gwen@beds.example,2024-04-08,16,44.9,37,North
"""
MESSY = """tool_id,tool_name,email,rented_date,age,deposit_total,damage_rate,shop_status,remarks,phone
701,  Belt sander  ,ute@tools.example,2024-02-01,3,40.00,5.0,OPEN,,+49-30-555-0101
702,Drill,ben(at)tools.example,2024-02-02,-9,35.00,4.0,OPEN,,030-555-0102
703,Ladder,,2024-02-03,4,-12.00,130.0,OPEN,,call me
704,Mixer,mia@tools.example,2024-02-04,5,38.50,-3.0,OPEN,,+49-30-555-0104
701,  Belt sander  ,ute@tools.example,2024-02-01,3,40.00,5.0,OPEN,,+49-30-555-0101
705,Saw,sam@tools.example,2024-02-05,4,90000.00,6.0,OPEN,,+49-30-555-0105
706,Pump,leo@two@tools.example,soon,6,42.00,5.5,OPEN,,030-555-0106
707,,noa@tools.example,2024-02-07,3,39.00,0.0,OPEN,,
"""
DUPLICATES = """member_id,choir_name,email,voice,joined_date
11,Ada Lund,ada@choir.example,ALTO,2021-09-01
12,Bo Krag,bo@choir.example,BASS,2021-09-08
11,Ada Lund,ada@choir.example,ALTO,2021-09-01
13,Cis Holm,cis@choir.example,TENOR,2021-10-02
12,Bo Krag Jr,bo.jr@choir.example,BASS,2022-01-15
"""
MISSING = """probe_id,station,district,backup_contact,nickname,depth,placed_date,notes
1,Weir,Harbour,,Wally,12,2020-05-01,
2,Lock,,Weir,,15,2020-05-03,
3,Bend,Meadow,,,,2020-05-04,
4,Ford,Meadow,,,,,
5,,Harbour,,,11,2020-05-09,
"""
INVALID = """ticket_id,rider_email,seat_quantity,fare,discount_percentage,phone,ride_date
1,kim@rail.example,2,14.50,10.0,+44 20 5550 0101,2022-06-01
2,kim_at_rail,1,15.50,140.0,ask later,2022-06-02
3,no-mail,-3,-4.00,-10.0,22,2022-06-31
4,lou@rail.example,4,16.00,0.0,+44 20 5550 0104,not yet
"""
ORCHARD = """id,name,email,age,country,pruned_date,taste_score
1,Old Pear,row1@orchard.example,31,NL,2021-02-01,70.5
2,Plum,row2-orchard,44,NL,2021-02-03,66.0
3,Quince,row3@orchard.example,-6,NL,2021-02-05,72.5
4,Apple,,28,NL,2021-02-08,
1,Old Pear,row1@orchard.example,31,NL,2021-02-01,70.5
6,Cherry,row6@orchard.example,35,NL,2021-02-11,950.0
7,Medlar,row7@orchard.example,39,NL,2021-02-15,68.0
"""
SIX_ROWS = """rating,remark,team,opened_at,model_year
4.0,Fine,Kiln,2020-03-01,2018
8.0,Very neat glaze,Kiln,2020-04-01,2019
12.0,Cracked,Wheel,2020-05-01,2018
16.0,,Press,2020-06-01,2020
20.0,Too thin,Kiln,2020-07-01,2021
,N/A,Wheel,2020-08-01,2018
"""
TO_CLEAN = """id,name,email,age,country,notes
1,Rosa Lind,rosa@mill.example,33,NO,Paid
2,Tom Berg  ,TOM@MILL.EXAMPLE,51,NO,  n/a  
3,Ulla   Dahl,ulla@mill.example,-4,NO,none
4,Per Moe,per-mill,47,NO,Due
1,Rosa Lind,rosa@mill.example,33,NO,Paid
"""

# (completeness, validity, uniqueness, consistency, overall)
SCORES = {
    "CLEAN": (100, 100, 100, 100, 100),
    "MESSY": (71, 18, 2, 51, 37),
    "DUPLICATES": (100, 100, 0, 100, 80),
    "MISSING": (13, 100, 100, 100, 74),
    "INVALID": (100, 0, 100, 75, 65),
    "ORCHARD": (96, 71, 0, 76, 65),
}
# (type, column, affected rows, percentage, severity) in detection order
ISSUES = {
    "CLEAN": [],
    "MESSY": [
        ("missing_values", "tool_name", 1, 12.5, "low"),
        ("missing_values", "email", 1, 12.5, "low"),
        ("empty_column", "remarks", 8, 100.0, "high"),
        ("missing_values", "phone", 1, 12.5, "low"),
        ("duplicate_rows", None, 2, 25.0, "high"),
        ("duplicate_identifier", "tool_id", 2, 25.0, "high"),
        ("duplicate_identifier", "email", 2, 25.0, "high"),
        ("invalid_email", "email", 2, 25.0, "high"),
        ("invalid_date", "rented_date", 1, 12.5, "high"),
        ("negative_value_violation", "age", 1, 12.5, "high"),
        ("impossible_percentage", "damage_rate", 2, 25.0, "high"),
        ("constant_column", "shop_status", 8, 100.0, "medium"),
        ("malformed_phone", "phone", 1, 12.5, "medium"),
        ("outliers", "age", 1, 12.5, "high"),
        ("outliers", "deposit_total", 2, 25.0, "high"),
        ("outliers", "damage_rate", 2, 25.0, "high"),
        ("whitespace_formatting_anomaly", "tool_name", 2, 25.0, "low"),
    ],
    "DUPLICATES": [
        ("duplicate_rows", None, 2, 40.0, "high"),
        ("duplicate_identifier", "member_id", 4, 80.0, "high"),
        ("duplicate_identifier", "email", 2, 40.0, "high"),
    ],
    "MISSING": [
        ("high_missing_percentage", "station", 1, 20.0, "medium"),
        ("high_missing_percentage", "district", 1, 20.0, "medium"),
        ("high_missing_percentage", "backup_contact", 4, 80.0, "high"),
        ("high_missing_percentage", "nickname", 4, 80.0, "high"),
        ("high_missing_percentage", "depth", 2, 40.0, "medium"),
        ("high_missing_percentage", "placed_date", 1, 20.0, "medium"),
        ("empty_column", "notes", 5, 100.0, "high"),
    ],
    "INVALID": [
        ("invalid_email", "rider_email", 2, 50.0, "high"),
        ("negative_value_violation", "seat_quantity", 1, 25.0, "high"),
        ("impossible_percentage", "discount_percentage", 2, 50.0, "high"),
        ("malformed_phone", "phone", 2, 50.0, "medium"),
        ("invalid_date", "ride_date", 2, 50.0, "high"),
        ("outliers", "fare", 1, 25.0, "high"),
        ("outliers", "discount_percentage", 1, 25.0, "high"),
    ],
    "ORCHARD": [
        ("missing_values", "email", 1, 14.29, "low"),
        ("missing_values", "taste_score", 1, 14.29, "low"),
        ("duplicate_rows", None, 2, 28.57, "high"),
        ("duplicate_identifier", "id", 2, 28.57, "high"),
        ("duplicate_identifier", "email", 2, 28.57, "high"),
        ("invalid_email", "email", 1, 14.29, "high"),
        ("negative_value_violation", "age", 1, 14.29, "high"),
        ("constant_column", "country", 7, 100.0, "medium"),
        ("outliers", "age", 1, 14.29, "high"),
        ("outliers", "taste_score", 1, 14.29, "high"),
    ],
}
