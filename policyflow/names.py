"""Fixed values that must equal the data format: column names, word lists, labels, limits."""

# Attribute key, display name, file-name patterns of its mapping tables.
ATTRIBUTES = [
    ("Inferred_Diagnosis_Code", "진단코드 (Diagnosis Code)", ["1_진단분류코드", "진단분류", "FCDF131"]),
    ("Inferred_Exemption_Code", "면책코드 (Exemption Code)", ["면책", "Exemption"]),
    ("Inferred_EDI_Code", "EDI코드 (EDI Code)", ["2_EDI코드", "EDI", "ZFSW072"]),
    ("Inferred_Hospital_Grade", "병원등급 (Hospital Grade)", ["4_병원등급", "병원등급"]),
    ("Inferred_Hospital_Class", "병원분류 (Hospital Classification)", ["3_병원분류", "병원분류", "ZFCW095"]),
    ("Inferred_Accident_Type", "사고유형 (Accident Type)", ["5_사고유형", "사고유형"]),
    ("Inferred_Admission_Limit", "입원한도일수 (Admission Limit Days)", ["6_입원한도", "입원한도"]),
    ("Inferred_Min_Admission", "최소입원일수 (Minimum Admission Days)", []),
    ("Inferred_Coverage_Period", "보장기간 (Coverage Period)", ["보장기간", "Period"]),
]

# Attribute key -> column of the wide result table.
ATTRIBUTE_COLUMNS = {
    "Inferred_Diagnosis_Code": "diagnosis_code",
    "Inferred_Exemption_Code": "exemption_code",
    "Inferred_EDI_Code": "edi_code",
    "Inferred_Hospital_Grade": "hospital_grade",
    "Inferred_Hospital_Class": "hospital_class",
    "Inferred_Accident_Type": "accident_type",
    "Inferred_Admission_Limit": "admission_limit",
    "Inferred_Min_Admission": "min_admission",
    "Inferred_Coverage_Period": "coverage_period",
}

EXPORT_COLUMNS = [
    "product_code", "benefit_code", "benefit_name", "sub_benefit_code", "template_name",
    "diagnosis_code", "exemption_code", "edi_code", "hospital_grade", "hospital_class",
    "accident_type", "admission_limit", "min_admission", "coverage_period",
    "confidence", "confidence_label", "source", "ref_page", "verification_status",
    "extracted_at", "provider_used",
]
REQUIRED_COLUMNS = [
    "product_code", "benefit_name", "template_name",
    "diagnosis_code", "confidence", "verification_status",
]
RESPONSE_FIELDS = [
    "benefit_name", "template_name", "inferred_code", "confidence", "source", "ref_page", "ref_sentence",
]
# Columns of the risk-item rows: risk name, item category code and name, item value code and name, reason.
RISK_FIELDS = ["위험률명", "항목구분코드", "항목구분명", "항목값코드", "항목값명", "선정근거"]
KEY_FIELDS = ["product_code", "benefit_code", "sub_benefit_code"]
COMPARE_FIELDS = list(ATTRIBUTE_COLUMNS.values())
CONFIRMED = ["auto_confirmed", "approved"]

# File-name keyword -> product type, tested in this order on the lower-cased name.
TYPE_KEYWORDS = [
    ("건강", "건강보험"), ("암", "건강보험"), ("질병", "건강보험"),
    ("자동차", "자동차보험"), ("차량", "자동차보험"),
    ("화재", "화재보험"), ("재물", "화재보험"),
    ("생명", "생명보험"), ("사망", "생명보험"),
    ("상해", "상해보험"), ("재해", "상해보험"),
]
UNCLASSIFIED = "미분류"

# File-name keyword = base category, tested in this order.
BASE_CATEGORIES = ["상해질병", "비용배상책임", "상해", "질병", "펫", "태아", "부양자"]
OTHER_CATEGORY = "기타"

LOOKUP_ERROR = "찾기에러"
NOTHING_FOUND = "관련 내용 없음"
UNMATCHED = "[미매칭: API 응답에서 해당 담보를 찾지 못함]"
MAPPING_NOT_FOUND = ("[주의] '", "' 관련 매핑 파일을 찾지 못했습니다.")
NO_MAPPING_TABLE = "해당 속성에 대한 매핑 테이블이 없습니다."
DEFAULT_LOGIC = "추출된 로직 없음. 표준 보험/의료 지식 활용."
OVERFLOW_MESSAGE = "... (오류 20개 초과, 중단)"
MAIN_TERMS = "메인 약관"
SECTION_SUFFIX = "관련 특별약관"
SECTION_MARKERS = ["관련 특별약관", "제도성 특별약관", "별표"]
# limits of the format, for callers that want them; nothing is limited unless asked
APPENDIX_CHARACTERS = 50_000
BUDGET_CHARACTERS = 100_000
ERRORS_PER_FILE = 20

CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮"

SOURCE_LABELS = {
    "appendix": "별표",
    "policy_text": "약관본문",
    "mapping_table": "매핑테이블",
    "external_knowledge": "외부지식",
    "gemini": "Gemini",
    "openai": "OpenAI",
    "claude": "Claude",
    "ensemble": "Ensemble",
}

AUTO_CONFIRM_LIMIT = 0.95
SCORES = {"high": 0.95, "medium": 0.7, "low": 0.4}
UNKNOWN_SCORE = 0.3
