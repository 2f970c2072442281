import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docledger.session import local_session, tune  # noqa: E402

SF = "/root/testdata/sf0.001"

RECEIPT = """
みどり文具 北口店
2024年5月8日 10:05

ノート               330円
ボールペン            220円

小計                  500円
消費税 (10%)           50円
合計                  550円

登録番号 T7000012050002
"""
INVOICE = """
御請求書

株式会社あおば設計

請求日: 令和5年11月30日
請求書番号: AB-2023-1130

品目             数量    単価      金額
図面作成           2     80,000   160,000円
現地調査           1     40,000    40,000円

小計                           200,000円
消費税 (10%)                    20,000円
合計                           220,000円

お支払期限: 令和5年12月28日
"""
HANDWRITTEN = """
No. 17    令和5年7月2日
領収書   大谷自治会 様
金額  ¥ 4,800-
夏まつり提灯の代金として、正に領収いたしました。
川辺商会  手書き
"""
CARD = """
ひまわりカード  ご利用明細のお知らせ
会員 佐野 様  (カード番号下4桁 0417)
利用日      利用先                 金額
2024/05/02  ENEOS 北町給油所     6,200円
2024/05/09  ホームセンター南      6,140円
合計 12,340円  お支払日 2024/06/10
"""


@pytest.fixture(scope="session")
def spark():
    s = local_session("docledger-tests", cores="4", partitions=4, memory="6g")
    tune(s)
    return s


@pytest.fixture(scope="session")
def samples(spark):
    rows = [("receipt", RECEIPT), ("invoice", INVOICE), ("handwritten", HANDWRITTEN), ("card", CARD)]
    return spark.createDataFrame(rows, "id string, text string")
