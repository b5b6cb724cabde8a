"""Ordered synonym tables of the typed search. Fixed values; the order decides which of several hits wins."""

from __future__ import annotations

#: Synonym to canonical institution.
UNI = {
    "chulalongkorn": "Chulalongkorn", "chula": "Chulalongkorn", "จุฬา": "Chulalongkorn", "จุฬาลงกรณ์": "Chulalongkorn",
    "เชียงใหม่": "Chiang Mai", "cmu": "Chiang Mai", "chiang mai": "Chiang Mai",
    "ธรรมศาสตร์": "Thammasat", "thammasat": "Thammasat", "tu": "Thammasat",
    "ราชมงคล": "Rajamangala", "rajamangala": "Rajamangala", "มหิดล": "Mahidol", "mahidol": "Mahidol", "mu": "Mahidol",
    "เกษตร": "Kasetsart", "kasetsart": "Kasetsart", "ขอนแก่น": "Khon Kaen", "khon kaen": "Khon Kaen",
    "สงขลา": "Prince of Songkla", "songkla": "Prince of Songkla", "psu": "Prince of Songkla",
    "สิลปากร": "Silpakorn", "silpakorn": "Silpakorn", "นเรศวร": "Naresuan", "naresuan": "Naresuan",
    "แม่ฟ้าหลวง": "Mae Fah Luang", "mae fah luang": "Mae Fah Luang", "มหาสารคาม": "Mahasarakham", "mahasarakham": "Mahasarakham",
    "ศรีนครินทรวิโรฒ": "Srinakharinwirot", "srinakharinwirot": "Srinakharinwirot", "ทักษิณ": "Thaksin", "thaksin": "Thaksin",
    "วลัยลักษณ์": "Walailak", "walailak": "Walailak", "สุรนารี": "Suranaree", "suranaree": "Suranaree",
    "พระจอมเกล้า": "King Mongkut", "kmitl": "King Mongkut", "บูรพา": "Burapha", "burapha": "Burapha",
    "แม่โจ้": "Maejo", "maejo": "Maejo", "รามคำแหง": "Ramkhamhaeng", "ramkhamhaeng": "Ramkhamhaeng", "เชียงราย": "Mae Fah Luang",
    "มช": "Chiang Mai", "มธ": "Thammasat", "มก": "Kasetsart", "มข": "Khon Kaen", "มศว": "Srinakharinwirot", "มรม": "Ramkhamhaeng",
    "มอ": "Prince of Songkla", "มน": "Naresuan", "มจ": "Maejo", "มฟล": "Mae Fah Luang", "มทส": "Suranaree", "มส": "Mahasarakham",
    "มทร": "Rajamangala", "มกฬ": "Mahidol", "สมช": "Srinakharinwirot",
}
#: Synonym to subject code.
SUBJ = {
    "physics": "64", "ฟิสิกส์": "64", "chem": "65", "chemistry": "65", "เคมี": "65", "bio": "66", "biology": "66", "ชีววิทยา": "66", "ชีวะ": "66",
    "math": "61", "maths": "61", "mathematics": "61", "คณิตศาสตร์": "61", "คณิต": "61", "english": "82", "ภาษาอังกฤษ": "82", "อังกฤษ": "82",
    "thai": "81", "ภาษาไทย": "81", "ไทย": "81", "social": "70", "สังคม": "70", "สังคมศึกษา": "70", "french": "83", "ฝรั่งเศส": "83",
    "chinese": "87", "จีน": "87", "japanese": "85", "ญี่ปุ่น": "85", "statistics": "63", "stat": "63", "สถิติ": "63",
}
STOP = set("ที่ ของ และ the a an of with needing need require requiring requires and more than over at in for to is are มี ต้องการ อยาก เรียน เข้า หลักสูตร programs program seats ที่นั่ง มากกว่า คน".split())
ROUND = {
    "portfolio": "R1", "แฟ้มสะสม": "R1", "รอบ 1": "R1", "รอบ1": "R1", "รอบที่1": "R1", "quota": "R2", "โควตา": "R2", "รอบ 2": "R2", "รอบ2": "R2", "รอบที่2": "R2",
    "admission": "R3", "รอบ 3": "R3", "รอบ3": "R3", "รอบที่3": "R3", "รับตรง": "R4", "รอบ 4": "R4", "รอบ4": "R4", "รอบที่4": "R4", "direct": "R4",
}
#: Keyword to label and match terms.
FACULTY = {
    "วิศวกรรม": ("Engineering", "วิศวกรรม engineering"), "วิศวะ": ("Engineering", "วิศวกรรม engineering"), "engineering": ("Engineering", "วิศวกรรม engineering"),
    "engineer": ("Engineering", "วิศวกรรม engineering"), "แพทย์": ("Medicine", "แพทยศาสตร์ medicine"), "medicine": ("Medicine", "แพทยศาสตร์ medicine"),
    "พยาบาล": ("Nursing", "พยาบาลศาสตร์ nursing"), "nursing": ("Nursing", "พยาบาลศาสตร์ nursing"), "เภสัช": ("Pharmacy", "เภสัชศาสตร์ pharmacy"),
    "ทันตแพทย์": ("Dentistry", "ทันตแพทย์ dentistry"), "วิทยาศาสตร์": ("Science", "วิทยาศาสตร์ science"), "science": ("Science", "วิทยาศาสตร์ science"),
    "อักษร": ("Arts", "อักษรศาสตร์ arts"), "ศิลปศาสตร์": ("Arts", "ศิลปศาสตร์ arts"), "arts": ("Arts", "ศิลปศาสตร์ arts"),
    "ศิลปกรรม": ("Fine Arts", "ศิลปกรรม fine arts"), "พาณิชย์": ("Business", "พาณิชย์ commerce business"), "บริหาร": ("Business", "บริหารธุรกิจ business"),
    "business": ("Business", "บริหารธุรกิจ business"), "นิติ": ("Law", "นิติศาสตร์ law"), "law": ("Law", "นิติศาสตร์ law"), "ครุ": ("Education", "ครุศาสตร์ education"),
    "ศึกษาศาสตร์": ("Education", "ศึกษาศาสตร์ education"), "นิเทศ": ("Communication", "นิเทศศาสตร์ communication"), "รัฐศาสตร์": ("Political Science", "รัฐศาสตร์ political"),
    "เศรษฐศาสตร์": ("Economics", "เศรษฐศาสตร์ economics"), "economics": ("Economics", "เศรษฐศาสตร์ economics"), "สถาปัตย": ("Architecture", "สถาปัตยกรรม architecture"),
    "เกษตร": ("Agriculture", "เกษตรศาสตร์ agriculture"), "สัตวแพทย์": ("Veterinary", "สัตวแพทย์ veterinary"), "เทคโนโลยี": ("Technology", "เทคโนโลยี technology"),
    "สาธารณสุข": ("Public Health", "สาธารณสุข public health"),
}
MAJOR = {
    "คอมพิวเตอร์": ("Computer", "คอมพิวเตอร์ computer"), "computer": ("Computer", "คอมพิวเตอร์ computer"), "คอม": ("Computer", "คอมพิวเตอร์ computer"),
    "ไอที": ("IT", "สารสนเทศ information technology IT"), "สารสนเทศ": ("IT", "สารสนเทศ information technology"), "ซอฟต์แวร์": ("Software", "ซอฟต์แวร์ software"),
    "ปัญญาประดิษฐ์": ("AI", "ปัญญาประดิษฐ์ artificial intelligence"), "ข้อมูล": ("Data Science", "ข้อมูล data"), "การตลาด": ("Marketing", "การตลาด marketing"),
    "marketing": ("Marketing", "การตลาด marketing"), "การเงิน": ("Finance", "การเงิน finance"), "finance": ("Finance", "การเงิน finance"),
    "การจัดการ": ("Management", "การจัดการ management"), "management": ("Management", "การจัดการ management"), "บัญชี": ("Accounting", "บัญชี accounting"),
    "accounting": ("Accounting", "บัญชี accounting"), "การออกแบบ": ("Design", "การออกแบบ design"), "design": ("Design", "การออกแบบ design"),
    "จิตวิทยา": ("Psychology", "จิตวิทยา psychology"), "psychology": ("Psychology", "จิตวิทยา psychology"),
    "กายภาพ": ("Physiotherapy", "กายภาพบำบัด physiotherapy physical therapy"), "โภชนาการ": ("Nutrition", "โภชนาการ nutrition"), "อาหาร": ("Food Science", "อาหาร food"),
    "การท่องเที่ยว": ("Tourism", "การท่องเที่ยว tourism"), "tourism": ("Tourism", "การท่องเที่ยว tourism"), "โลจิสติกส์": ("Logistics", "โลจิสติกส์ logistics"),
    "สื่อสารมวลชน": ("Mass Com", "สื่อสารมวลชน mass communication"), "ดนตรี": ("Music", "ดนตรี music"), "ทัศนศิลป์": ("Visual Arts", "ทัศนศิลป์ visual arts"),
    "สังคมวิทยา": ("Sociology", "สังคมวิทยา sociology"), "วิศวกรรมคอมพิวเตอร์": ("Computer Eng", "วิศวกรรมคอมพิวเตอร์ computer engineering"),
}
#: Keyword to label and filter on the name.
FORMAT = {
    "ภาคปกติ": ("Regular", None), "regular": ("Regular", None), "ภาคพิเศษ": ("Special", "ภาคพิเศษ"), "special": ("Special", "ภาคพิเศษ"),
    "evening": ("Special", "ภาคพิเศษ"), "พิเศษ": ("Special", "ภาคพิเศษ"), "ทวิภาคี": ("Dual Degree", "ทวิภาคี"), "dual": ("Dual Degree", "ทวิภาคี"),
    "double": ("Dual Degree", "ทวิภาคี"), "bilingual": ("Bilingual", "bilingual"), "สองภาษา": ("Bilingual", "bilingual"),
    "ต่อเนื่อง": ("Integrated", "ต่อเนื่อง"), "sandbox": ("Sandbox", "sandbox"),
}
INTENT = {
    "เกณฑ์": "criteria", "คะแนน": "criteria", "น้ำหนัก": "criteria", "ต้องใช้": "criteria", "คุณสมบัติ": "criteria", "criteria": "criteria",
    "เทียบ": "compare", "เปรียบเทียบ": "compare", "ดีกว่า": "compare", "อันไหนดี": "compare", "อาชีพ": "career", "เงินเดือน": "career", "หางาน": "career", "จ้าง": "career",
    "ทุน": "cost", "เรียนฟรี": "cost", "ค่าเทอม": "cost", "ค่าเล่าเรียน": "cost", "ถูก": "cost",
}
ABBREV = {
    "วิศวะ": "วิศวกรรม", "คอม": "คอมพิวเตอร์", "แพทย์": "แพทยศาสตร์", "เมด": "แพทยศาสตร์", "พยาบาล": "พยาบาลศาสตร์", "บัญชี": "บัญชีบัณฑิต", "สถาปัตย์": "สถาปัตยกรรม",
    "นิเทศ": "นิเทศศาสตร์", "เภสัช": "เภสัชศาสตร์", "ทันต": "ทันตแพทย์", "สัตว์": "สัตวแพทย์", "เกษตร": "เกษตรศาสตร์", "นิติ": "นิติศาสตร์", "ครุ": "ครุศาสตร์",
}
#: Terms that a segmenter must not split.
CORE = (
    "ค่าน้ำหนัก", "ร้อยละ", "รหัสวิชา", "จำนวนรับ", "จำนวนรับตามแผน", "รอบที่", "รับตรง", "รับตรงร่วมกัน", "แฟ้มสะสมผลงาน", "ความถนัด", "ความถนัดทั่วไป",
    "ไม่น้อยกว่า", "สาขาวิชา", "คุณสมบัติผู้สมัคร", "เกณฑ์ขั้นต่ำ", "สัดส่วน", "Adj. T-SCORE", "คะแนนรวม", "นักเรียน", "คัดเลือก", "ร่วมกัน", "เทียบวุฒิ",
    "คณิตศาสตร์ประยุกต์", "วิทยาศาสตร์ประยุกต์", "สังคมศึกษา", "ภาษาอังกฤษ", "ภาษาไทย", "วิศวกรรมศาสตร์", "คณะวิศวกรรมศาสตร์", "หลักสูตร",
)
#: Subject codes' English names.
SUBJECT_EN = {
    "61": "Math1", "62": "Math2", "63": "Stat", "64": "Physics", "65": "Chem", "66": "Bio", "67": "Sci", "70": "Social", "71": "Geo", "72": "History",
    "73": "Religion", "74": "Citizen", "75": "Econ", "80": "Design&Tech", "81": "Thai", "82": "English", "83": "French", "84": "German", "85": "Japanese",
    "86": "Korean", "87": "Chinese", "88": "Pali", "89": "Spanish", "GPAX": "GPAX", "TGAT": "TGAT", "TGAT1": "TGAT1", "TGAT2": "TGAT2", "TGAT3": "TGAT3",
    "TPAT2": "TPAT2", "TPAT3": "TPAT3", "TPAT4": "TPAT4", "TPAT5": "TPAT5",
}
