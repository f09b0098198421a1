"""Explicit read schemas: nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_TYPES: dict[str, DataType] = {"string": StringType(), "double": DoubleType(), "boolean": BooleanType(), "timestamp": TimestampType(), "int": IntegerType(), "bigint": LongType()}


def flat(ddl: str) -> StructType:
    """A schema of scalar columns; needs no running session."""
    return StructType([StructField(n, _TYPES[t]) for n, t in (c.split() for c in ddl.split(","))])


RAW_POSTING = flat(
    "external_id string, title string, description_html string, description_text string, apply_url string, location_raw string, posted_at timestamp, updated_at timestamp, "
    "remote_type string, remote_hint boolean, employment_type string, salary_min double, salary_max double, salary_currency string, salary_period string"
)
COMPANIES = flat(
    "id string, name string, slug string, domain string, ats_provider string, ats_token string, stage string, size string, logo_url string, description string, created_at timestamp"
)
SOURCES = flat("id string, company_id string, ats_provider string, endpoint_url string, last_polled_at timestamp, status string")
JOBS = flat(
    "id string, company_id string, source_id string, external_id string, slug string, title string, normalized_title string, description_html string, description_text string, "
    "apply_url string, location_raw string, country string, region string, city string, remote_type string, seniority string, salary_min double, salary_max double, "
    "salary_currency string, salary_period string, classification string, classification_confidence double, is_featured boolean, is_direct boolean, is_new boolean, is_closed boolean, "
    "posted_at timestamp, updated_at timestamp, ingested_at timestamp, expires_at timestamp, content_hash string, dedup_key string, last_seen_at timestamp"
)
SKILLS = flat("id string, name string, cluster string")
JOB_SKILLS = flat("job_id string, skill_id string")
EMPLOYER_ORDERS = flat("id string, company_id string, job_id string, product string, amount bigint, currency string, status string, created_at timestamp")
SUBSCRIBERS = flat("id string, email string, filters string, frequency string, created_at timestamp")
USERS = flat("id string, email string, role string, created_at timestamp")

#: Landed answers of boards: one row a page of a list, or one a detail.
PAGES = flat("slug string, query int, page int, url string, body string")
DETAILS = flat("slug string, key string, url string, body string")

LIST = {
    "greenhouse": "jobs array<struct<id: bigint, title: string, location: struct<name: string>, absolute_url: string, updated_at: string, first_published: string, content: string>>",
    "lever": "array<struct<id: string, text: string, hostedUrl: string, applyUrl: string, description: string, descriptionPlain: string, categories: struct<location: string, commitment: string, allLocations: array<string>>, createdAt: bigint, workplaceType: string>>",
    "ashby": "jobs array<struct<id: string, title: string, location: string, isRemote: boolean, workplaceType: string, employmentType: string, jobUrl: string, applyUrl: string, descriptionHtml: string, descriptionPlain: string, publishedAt: string, updatedAt: string, isListed: boolean, compensation: struct<scrapeableCompensationSalarySummary: string, compensationTierSummary: string>>>",
    "workable": "jobs array<struct<shortcode: string, title: string, employment_type: string, telecommuting: boolean, application_url: string, shortlink: string, url: string, published_on: string, country: string, city: string, state: string>>",
    "recruitee": "offers array<struct<id: bigint, title: string, status: string, description: string, requirements: string, careers_url: string, careers_apply_url: string, location: string, city: string, country: string, remote: boolean, hybrid: boolean, on_site: boolean, employment_type_code: string, created_at: string, published_at: string, updated_at: string>>",
    "teamtailor": "items array<struct<id: string, title: string, url: string, date_published: string, content_html: string, _jobposting: struct<jobLocation: array<struct<address: struct<addressLocality: string, addressRegion: string, addressCountry: string>>>>>>",
    "smartrecruiters": "content array<struct<id: string, name: string, refNumber: string, releasedDate: string, location: struct<city: string, region: string, country: string, remote: boolean, hybrid: boolean, fullLocation: string>, typeOfEmployment: struct<label: string>, ref: string>>, totalFound bigint",
    "workday": "jobPostings array<struct<title: string, externalPath: string, locationsText: string, bulletFields: array<string>>>, total bigint",
    "oracle": "items array<struct<requisitionList: array<struct<Id: string, Title: string, PostedDate: string, PrimaryLocation: string, secondaryLocations: array<struct<Name: string>>>>>>",
    "eightfold": "positions array<struct<id: string, name: string, location: string, locations: array<string>, t_create: bigint, t_update: bigint, canonicalPositionUrl: string, job_description: string, work_location_option: string>>",
}
DETAIL = {
    "workable": "description string, requirements string, benefits string, workplace string, remote boolean, location struct<country: string, city: string, region: string>",
    "smartrecruiters": "postingUrl string, applyUrl string, location struct<city: string, region: string, country: string, remote: boolean, hybrid: boolean, fullLocation: string>, typeOfEmployment struct<label: string>, jobAd struct<sections: map<string, struct<title: string, text: string>>>",
    "workday": "jobPostingInfo struct<title: string, jobDescription: string, location: string, startDate: string, timeType: string, jobReqId: string, externalUrl: string>",
    "oracle": "items array<struct<ExternalDescriptionStr: string, ExternalResponsibilitiesStr: string, ExternalQualificationsStr: string, PostedDate: string, PrimaryLocation: string>>",
}
