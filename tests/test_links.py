"""Closed postings: what tells a live one from a dead page."""

import pytest
from pyspark.sql import functions as F

from rolecall.operators import links


@pytest.mark.parametrize(("asked", "final", "away"), [
    ("https://job-boards.greenhouse.io/stripe/jobs/1111111", "https://stripe.com/careers/search", True),
    ("https://www.instahyre.com/job-425496-sde-at-acme/", "https://www.instahyre.com/search-jobs/", True),
    ("https://boards.greenhouse.io/acme/jobs/123456", "https://job-boards.greenhouse.io/acme/jobs/123456", False),
    ("http://x.test/careers/job/software-engineer-intern", "https://x.test/careers/job/software-engineer-intern", False),
    ("https://jobs.lever.co/acme/abc-123", "https://jobs.lever.co/acme/abc-123/", False),
    ("https://x.test/jobs", "https://x.test/", False), (None, "https://x.test/", False),
])
def test_redirects(spark, asked, final, away):
    assert spark.createDataFrame([(asked, final)], "a string, b string").select(links.redirected_away(F.col("a"), F.col("b"))).first()[0] is away


@pytest.mark.parametrize(("key", "url", "api"), [
    ("marvell:marvellcareers2:/job/Hyderabad/Intern_R1", "https://marvell.wd1.myworkdayjobs.com/marvellcareers2/job/Hyderabad/Intern_R1", "https://marvell.wd1.myworkdayjobs.com/wday/cxs/marvell/marvellcareers2/job/Hyderabad/Intern_R1"),
    ("no-colons", "https://example.test/x", None), ("a:b:/job/x", "https://example.test/x", None), ("a:b:/job/x", "", "https://a.wd1.myworkdayjobs.com/wday/cxs/a/b/job/x"),
])
def test_endpoint(spark, key, url, api):
    assert spark.createDataFrame([(key, url)], "a string, b string").select(links.workday_api_url(F.col("a"), F.col("b"))).first()[0] == api
