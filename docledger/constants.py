"""Word lists, lookup tables, patterns and thresholds the results depend on."""

# --- fixed values: date patterns, tried in this order (name, pattern, years added) ---------------
DATE_PATTERNS = [
    ("reiwa", r"令和\s*(\d{1,2})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", 2018),
    ("heisei", r"平成\s*(\d{1,2})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", 1988),
    ("showa", r"昭和\s*(\d{1,2})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", 1925),
    ("gregorian", r"(20\d{2})\s*[年/\-\.]\s*(\d{1,2})\s*[月/\-\.]\s*(\d{1,2})\s*日?", 0),
    ("short_gregorian", r"(\d{2})[/\-\.](\d{1,2})[/\-\.](\d{1,2})", 2000),
    ("month_day_only", r"(\d{1,2})\s*月\s*(\d{1,2})\s*日", None),
]

# literals a date or vendor pattern cannot match without
DATE_LITERALS = {
    "reiwa": ["令和"], "heisei": ["平成"], "showa": ["昭和"], "gregorian": ["20"], "short_gregorian": ["/", "-", "."], "month_day_only": ["月"],
}

# --- fixed values: amount patterns, tried in this order ------------------------------------------
AMOUNT_PATTERNS = {
    "total": r"(?=[合お総小請ご])(?:合計|お会計|総合計|小計\s*合計|請求金額|ご請求金額|お支払い?金額|合計金額)[^\d\n]*¥?\s*([\d,，]+)",
    "total_tax_included": r"(?:税込(?:合計)?|税込金額)[^\d\n]*¥?\s*([\d,，]+)",
    "subtotal": r"(?=[税本小])(?:税抜(?:合計)?|税抜金額|本体価格|本体金額|小計)[^\d\n]*¥?\s*([\d,，]+)",
    "tax_10": r"(?:消費税(?:額)?|税額)\s*(?:\(10%\)|10%|（10%）)[^\d\n]*¥?\s*([\d,，]+)",
    "tax_8": r"(?:消費税(?:額)?|税額)\s*(?:\(8%\)|8%|（8%）)[^\d\n]*¥?\s*([\d,，]+)",
    "tax_total": r"(?:消費税(?:額)?|内消費税|税)[^\d\n]*¥?\s*([\d,，]+)",
    "yen_amount": r"¥\s*([\d,，]+)",
}

# literals an amount, identifier or contact pattern cannot match without
AMOUNT_LITERALS = {
    "total": ["合計", "お会計", "請求金額", "お支払"], "total_tax_included": ["税込"], "subtotal": ["小計", "税抜", "本体"], "tax_10": ["10%"], "tax_8": ["8%"],
    "tax_total": ["税"], "yen_amount": ["¥"],
}
INVOICE_NO_LITERALS = ["番号", "No", "NO", "no", "nO"]
PHONE_LITERALS = ["-"]
ADDRESS_LITERALS = ["-", "東京都", "大阪府", "京都府", "北海道", "県"]

# --- fixed values: identifier, vendor and contact patterns ---------------------------------------
REGISTRATION_NO_PATTERN = r"[Tt]\s*(\d{13})"
INVOICE_NO_PATTERN = r"(?:請求書?番号|No\.?|番号)[^\d\n]*([A-Z0-9\-\/]{3,30})"
PHONE_PATTERN = r"(\d{2,4}[-\-]\d{2,4}[-\-]\d{3,4})"
ADDRESS_PATTERN = r"〒?\s*\d{3}[-\-]\d{4}[^\n]*|(?:東京都|大阪府|京都府|北海道|.{2}県).{5,80}"
VENDOR_PATTERNS = [
    r"(?:発行元|店舗名|取引先|請求元|会社名)[：:]\s*(.+)",
    r"(?:㈱|株式会社|有限会社|合同会社|一般社団法人|公益財団法人)\s*(.{1,30})",
    r"(.{1,30})\s*(?:㈱|株式会社|有限会社|合同会社)",
]
VENDOR_LITERALS = [
    ["発行元", "店舗名", "取引先", "請求元", "会社名"],
    ["㈱", "株式会社", "有限会社", "合同会社", "一般社団法人", "公益財団法人"],
    ["㈱", "株式会社", "有限会社", "合同会社"],
]
VENDOR_LINE_EXCLUDED = ["年", "月", "合計", "小計", "¥"]
LINE_ITEM_PATTERN = r"(.{1,30}?)\s{2,}(\d+)\s*(?:個|本|枚|冊|点|式)?\s+([\d,，]+)\s+([\d,，]+)"

# --- fixed values: payment method keywords, first group wins -------------------------------------
PAYMENT_KEYWORDS = {
    "現金": ["現金", "CASH", "cash"],
    "クレジットカード": ["カード", "クレジット", "VISA", "Mastercard", "AMEX", "JCB"],
    "電子マネー": ["Suica", "PASMO", "iD", "楽天Edy", "nanaco", "WAON", "PayPay", "LINE Pay"],
    "銀行振込": ["振込", "振り込み", "ATM", "銀行"],
    "口座引落": ["口座引落", "自動引落", "口座振替"],
}

# --- fixed values: account title keywords in document text, first group wins ---------------------
ACCOUNT_KEYWORDS = {
    "旅費交通費": ["電車", "バス", "タクシー", "新幹線", "高速道路", "駐車場", "航空"],
    "交際費": ["ホテル", "レストラン", "居酒屋", "接待", "食事", "ラウンジ"],
    "消耗品費": ["文具", "コンビニ", "100均", "文房具", "オフィス用品"],
    "通信費": ["NTT", "ドコモ", "au", "ソフトバンク", "インターネット", "電話"],
    "水道光熱費": ["電気", "ガス", "水道"],
    "会議費": ["会議", "ミーティング", "打ち合わせ", "コーヒー", "カフェ"],
    "新聞図書費": ["書店", "コンビニ", "新聞", "本", "雑誌"],
    "福利厚生費": ["薬局", "ドラッグストア", "クリニック"],
}

# --- fixed values: document types and their keywords ---------------------------------------------
DOC_TYPES = ["receipt", "handwritten", "invoice", "card_statement", "bank_statement"]
TYPE_KEYWORDS = {
    "receipt": [
        "レシート", "領収証", "receipt", "RECEIPT", "お買い上げ", "ありがとうございました", "税込合計",
        "税抜合計", "お会計", "税込", "小計", "点", "割引", "Suica", "PayPay", "iD", "Tポイント", "円引", "OFF",
        "レシートNO", "レシートNo", "レシートno", "お客様番号", "登録番号",
    ],
    "handwritten": ["領収書", "上様", "但し", "收入印紙", "収入印紙", "印紙", "担当者"],
    "invoice": [
        "請求書", "御請求書", "請求金額", "支払期日", "振込先", "銀行口座", "口座番号", "品目", "数量", "単価",
        "下記の通り", "適格請求書発行事業者", "適格請求書", "インボイス番号", "請求書番号",
    ],
    "card_statement": [
        "カード明細", "利用明細", "クレジット", "ご利用金額", "支払日", "締め日", "ポイント", "VISA", "Mastercard",
        "JCB", "AMEX", "お引き落とし金額",
    ],
    "bank_statement": [
        "預金通帳", "口座明細", "残高", "入金", "出金", "振込", "引落", "ATM", "普通預金", "当座預金",
    ],
}
TYPE_NEGATIVE_KEYWORDS = {
    "receipt": ["請求書", "振込先", "支払期日"],
    "invoice": ["お買い上げ", "レシート"],
}
FORCE_REVIEW_TYPES = ["handwritten", "card_statement", "bank_statement"]

# --- fixed values: registration number patterns --------------------------------------------------
FULLWIDTH_DIGITS = "０１２３４５６７８９"
# with the literals of which one must be present; full-width digits are narrowed before
REGISTRATION_PATTERNS = [
    (["T", "t", "Ｔ", "ｔ"], r"[TtＴｔ]\s*(\d{13})"),
    (["登録番号", "インボイス番号", "適格請求書"], r"(?:登録番号|インボイス番号|適格請求書)[^\dTＴ]*[TＴ]?\s*(\d{13})"),
    (["-", "ー"], r"(\d{1}[-ー]\d{4}[-ー]\d{4}[-ー]\d{4})"),
]

# --- fixed values: personal data patterns, (kind, placeholder, pattern) --------------------------
PII_PATTERNS = {
    "my_number": ("MY_NUMBER", [
        r"(?:個人番号|マイナンバー|My\s*Number)[^\d]*(\d{4}[\s\-]?\d{4}[\s\-]?\d{4})",
        r"(?<!\d)(\d{4}[-\s]\d{4}[-\s]\d{4})(?!\d)",
    ]),
    "bank": ("BANK_ACCOUNT", [
        r"(?:口座番号|普通預金|当座預金|預金口座)[^\d]*(\d{7,8})",
        r"(?:振込先|振込口座)[^\d]*(\d{4}[-\s]\d{3}[-\s]\d{7,8})",
        r"(?<!\d)(\d{4}[-\s]\d{3}[-\s]\d{7,8})(?!\d)",
    ]),
    "card": ("CARD_NUMBER", [
        r"(?<!\d)(?<![Tt])(\d{4}[-\s]\d{4}[-\s]\d{4}[-\s]\d{4}|\d{16})(?!\d)",
    ]),
    "phone": ("PHONE", [r"(?:TEL|Tel|電話)?[\s:：]*(\d{2,4}[-\-]\d{2,4}[-\-]\d{3,4})"]),
    "email": ("EMAIL", [r"([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})"]),
}

# --- fixed values: default vendor keyword rules (keywords, account, tax), first rule wins --------
DEFAULT_TAX = "課税仕入10%"
KEYWORD_RULES = [
    (["コンビニ", "セブン", "ファミマ", "ローソン", "ミニストップ", "ヤマザキ"], "消耗品費", "課税仕入10%"),
    (["電車", "バス", "タクシー", "新幹線", "高速", "駐車", "JR", "東京メトロ"], "旅費交通費", "課税仕入10%"),
    (["ガソリン", "給油", "石油", "ENEOS", "出光", "昭和シェル"], "旅費交通費", "課税仕入10%"),
    (["ホテル", "旅館", "宿泊", "リゾート", "inn"], "旅費交通費", "課税仕入10%"),
    (["レストラン", "食堂", "居酒屋", "焼肉", "ラーメン", "すし", "定食"], "交際費", "課税仕入10%"),
    (["スーパー", "イオン", "西友", "コープ", "マルエツ"], "消耗品費", "課税仕入10%"),
    (["NTT", "ドコモ", "au", "ソフトバンク", "楽天モバイル", "インターネット", "Wi-Fi"], "通信費", "課税仕入10%"),
    (["電気", "東京電力", "関西電力", "中部電力"], "水道光熱費", "課税仕入10%"),
    (["ガス", "東京ガス", "大阪ガス"], "水道光熱費", "課税仕入10%"),
    (["水道"], "水道光熱費", "非課税"),
    (["書店", "本", "雑誌", "新聞", "ブック"], "新聞図書費", "課税仕入10%"),
    (["薬局", "ドラッグ", "マツキヨ", "ウエルシア", "ツルハ"], "福利厚生費", "課税仕入10%"),
    (["文具", "コクヨ", "文房具", "はんこ", "スタンプ"], "消耗品費", "課税仕入10%"),
    (["カフェ", "コーヒー", "スタバ", "スターバックス", "ドトール", "タリーズ", "コメダ", "珈琲"], "会議費", "課税仕入10%"),
    (["アマゾン", "Amazon", "楽天", "Yahoo"], "消耗品費", "課税仕入10%"),
    (["弁当", "惣菜", "デリ"], "福利厚生費", "課税仕入8%軽減"),
]
TAX_ALIASES = {
    "課税10%": "課税仕入10%",
    "課税8%": "課税仕入8%軽減",
    "課税仕入8%": "課税仕入8%軽減",
    "軽減8%": "課税仕入8%軽減",
    "非課税": "非課税",
    "不課税": "不課税",
    "免税": "不課税",
}

# --- fixed values: suggestion confidences --------------------------------------------------------
CONF_EXACT, CONF_PARTIAL, CONF_GLOBAL, CONF_KEYWORD, CONF_GIVEN, CONF_NO_VENDOR = 0.97, 0.85, 0.90, 0.70, 0.60, 0.30

# --- fixed values: account and tax masters (name: freee, money_forward, yayoi) -------------------
ACCOUNT_MASTER = {
    "消耗品費": (1012, "消耗品費", "消耗品費"),
    "旅費交通費": (1013, "旅費交通費", "旅費交通費"),
    "交際費": (1020, "交際費", "交際費"),
    "会議費": (1021, "会議費", "会議費"),
    "通信費": (1011, "通信費", "通信費"),
    "水道光熱費": (1014, "水道光熱費", "水道光熱費"),
    "広告宣伝費": (1009, "広告宣伝費", "広告宣伝費"),
    "新聞図書費": (1022, "新聞図書費", "新聞図書費"),
    "福利厚生費": (1017, "福利厚生費", "福利厚生費"),
    "外注費": (1018, "外注費", "外注費"),
    "地代家賃": (1015, "地代家賃", "地代家賃"),
    "修繕費": (1019, "修繕費", "修繕費"),
    "雑費": (1025, "雑費", "雑費"),
    "現金": (1, "現金", "現金"),
    "未払金": (103, "未払金", "未払金"),
    "普通預金": (10, "普通預金", "普通預金"),
}
TAX_MASTER = {
    "課税仕入10%": (17, "課税仕入10%", "10"),
    "課税仕入8%軽減": (30, "課税仕入8%軽", "11"),
    "非課税": (14, "非課税仕入", "14"),
    "不課税": (0, "対象外", "0"),
}
DEFAULT_DEBIT, DEFAULT_CREDIT, DEFAULT_PAYABLE, CASH = "消耗品費", "現金", "未払金", "現金"

# --- fixed values: deal payload codes ------------------------------------------------------------
DEAL_TAX_CODES = {"課税仕入10%": 17, "課税仕入8%軽減": 30, "非課税": 14, "不課税": 0, "課税売上10%": 33}
DEAL_ACCOUNT_CODES = {
    "消耗品費": 1012, "旅費交通費": 1013, "交際費": 1020, "通信費": 1011, "会議費": 1021, "水道光熱費": 1014,
    "新聞図書費": 1022, "福利厚生費": 1017, "外注費": 1018, "地代家賃": 1015, "修繕費": 1019, "雑費": 1025,
}
DEAL_WALLETS = {"現金": 1, "クレジットカード": 2, "銀行振込": 3, "口座引落": 3, "電子マネー": 1}

# --- fixed values: export headers ----------------------------------------------------------------
FREEE_HEADERS = [
    "管理番号", "取引日", "借方勘定科目", "借方税区分", "借方金額(円)", "借方税額", "貸方勘定科目", "貸方税区分",
    "貸方金額(円)", "貸方税額", "摘要", "仕訳メモ", "タグ", "MF取引ID",
]
MF_HEADERS = [
    "日付", "借方勘定科目", "借方補助科目", "借方部門", "借方税区分", "借方金額", "借方税額", "貸方勘定科目",
    "貸方補助科目", "貸方部門", "貸方税区分", "貸方金額", "貸方税額", "摘要", "号",
]
YAYOI_BANNER = ['"', "弥生会計", "インポート用"] + [""] * 20
YAYOI_HEADERS = [
    "*", "伝票No", "決算", "取引日付", "借方勘定科目", "借方補助科目", "借方部門", "借方金額", "借方消費税額",
    "借方税区分", "借方税込区分", "貸方勘定科目", "貸方補助科目", "貸方部門", "貸方金額", "貸方消費税額",
    "貸方税区分", "貸方税込区分", "摘要", "番号", "期日", "タイプ", "生成元",
]
GENERIC_HEADERS = [
    "管理ID", "ファイル名", "書類種別", "取引日", "取引先名", "取引先住所", "取引先電話番号", "適格請求書番号",
    "請求書番号", "合計金額(税込)", "税抜金額", "消費税額(10%)", "消費税額(8%)", "支払方法", "勘定科目", "備考",
    "OCR信頼度", "承認者", "承認日時",
]
EXPORT_FORMATS = [
    ("freee", "freee会計", "freee会計 仕訳インポートCSV（UTF-8 BOM付き）", "UTF-8 BOM"),
    ("money_forward", "マネーフォワード クラウド会計", "マネーフォワード 仕訳帳CSVインポート（UTF-8 BOM付き）", "UTF-8 BOM"),
    ("yayoi", "弥生会計", "弥生会計 仕訳日記帳CSVインポート（Shift-JIS）", "Shift-JIS"),
    ("generic_csv", "汎用CSV", "全フィールドを含む汎用CSVファイル（UTF-8 BOM付き）", "UTF-8 BOM"),
]

# --- fixed values: scoring -----------------------------------------------------------------------
SCORE_WEIGHTS = {
    "transaction_date": "0.20", "total_amount": "0.30", "vendor_name": "0.20", "tax_amount": "0.15", "arithmetic": "0.15",
}
THRESHOLD_AUTO, THRESHOLD_REVIEW = "0.85", "0.55"
REASON_DATE = "取引日が抽出できませんでした"
REASON_TOTAL = "合計金額が抽出できませんでした"
REASON_VENDOR = "取引先名が抽出できませんでした"
REASON_TAX = "消費税額が不明（10%税区分で計算してください）"
REASON_ARITHMETIC = "金額の検算が合いません。手動で確認してください"
REASON_BY_TYPE = {
    "handwritten": "手書き領収書のため担当者確認が必要です",
    "card_statement": "カード明細のため担当者確認が必要です",
    "bank_statement": "通帳・銀行明細のため担当者確認が必要です",
}

# --- fixed values: labels shown to people --------------------------------------------------------
DOC_TYPE_LABELS = {
    "receipt": "レシート", "handwritten": "手書き領収書", "invoice": "請求書", "card_statement": "カード明細",
    "bank_statement": "銀行明細", "unknown": "不明",
}
STATUS_LABELS = {
    "uploaded": "未処理", "processing": "処理中", "pending": "確認待ち", "approved": "承認済み", "rejected": "差し戻し",
    "exported": "エクスポート済み",
}
TIER_MESSAGES = {
    "auto_confirmed": "✅ 高精度で自動承認されました",
    "needs_review": "⚠️ OCR結果を確認してください",
    "manual_input": "✏️ 手入力が必要です",
}
TIER_MESSAGE_DEFAULT = "処理完了"

# --- fixed values: intake, audit, retention ------------------------------------------------------
SUPPORTED_EXTENSIONS = [".jpg", ".jpeg", ".png", ".pdf", ".tiff", ".tif", ".bmp", ".webp"]
MIME_BY_EXTENSION = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".pdf": "application/pdf",
    ".tiff": "image/tiff", ".tif": "image/tiff", ".bmp": "image/bmp", ".webp": "image/webp",
}
MONTHLY_DOC_TARGET = 500
PEAK_MONTHS = [2, 3]
MIN_DPI = 200
MIN_FILE_BYTES = 5000
AUDIT_EVENTS = [
    "auth.login", "auth.logout", "auth.login_failed", "document.upload", "document.view", "document.approve",
    "document.reject", "document.edit", "document.delete", "document.export", "journal.create", "journal.edit",
    "journal.approve", "client.create", "client.edit", "settings.change", "ai.request", "export.csv", "export.api_call",
]
OCR_FALLBACK_THRESHOLD = 0.70
