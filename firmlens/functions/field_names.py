"""Column names of the licensed sources and the panel's names for them."""

from __future__ import annotations

# Fundamentals.
FUNDAMENTALS = {
    "ITEM6008": "isin",
    "year_": "year",
    "ITEM6011": "industry_group",
    "ITEM5601": "worldscope_ticker",
    "ITEM6105": "worldscope_permno",
    "ITEM1001": "sales",
    "ITEM7240": "salesUSD",
    "ITEM1148": "deprec",
    "ITEM1151": "deprec_amort",
    "ITEM18274": "impairment_ppe",
    "ITEM18225": "impairment_gw",
    "ITEM1250": "opinc",
    "ITEM1751": "netinc",
    "ITEM7250": "netincUSD",
    "ITEM2300": "assets_asreported",
    "ITEM2999": "assets",
    "ITEM2301": "ppe_gross",
    "ITEM2401": "deprec_accum",
    "ITEM2501": "ppe_net",
    "ITEM7230": "assetsUSD",
    "ITEM3255": "debt",
    "ITEM3260": "risk_provisions",
    "ITEM1302": "op_provisions",
    "ITEM7210": "mkcapUSD",
    "ITEM7220": "equityUSD",
}
# Provider scores and disclosures (field of the long table -> column).
PROVIDER_FIELDS = {
    "ESGScore": "ref_esg_score",
    "ESGCombinedScore": "ref_esg_combined_score",
    "ESGCControversiesScore": "ref_esg_controversies_score",
    "EnvironmentPillarScore": "ref_env_score",
    "SocialPillarScore": "ref_soc_score",
    "GovernancePillarScore": "ref_gov_score",
    "ESGResourceUseScore": "ref_res_use_score",
    "ESGEmissionsScore": "ref_emissions_score",
    "ESGInnovationScore": "ref_innovation_score",
    "ESGWorkforceScore": "ref_workforce_score",
    "ESGHumanRightsScore": "ref_human_rights_score",
    "ESGCommunityScore": "ref_community_score",
    "ESGProductResponsibilityScore": "ref_product_responsibility_score",
    "ESGManagementScore": "ref_management_score",
    "ESGShareholdersScore": "ref_shareholders_score",
    "ESGCsrStrategyScore": "ref_csr_strategy_score",
    "CO2EquivalentsEmissionDirectScope1": "ref_scope1",
    "CO2EquivalentsEmissionIndirectScope2": "ref_scope2",
    "CO2EquivalentsEmissionIndirectScope3": "ref_scope3",
    "CO2EquivalentsEmissionTotal": "ref_total",
    "ClimateChangeCommercialRisksOpportunities": "climate_commercial_riskopp_aware",
    "CarbonOffsetsCredits": "carbon_offsets",
    "EmissionReductionTargetPercentage": "emission_reduction_target",
    "EmissionReductionTargetYear": "emission_reduction_target_year",
    "EmissionsTrading": "emission_trading",
    "CsrSustainabilityCommittee": "csr_sust_committee",
    "CsrSustainabilityExternalAudit": "csr_assurance",
    "CsrSustainabilityExternalAuditorName": "csr_assurance_name",
    "CsrSustainabilityReportGlobalActivities": "csr_global_scope",
    "CsrSustainabilityReporting": "csr_separate_report",
    "ESGReportingScope": "esg_reporting_scope",
    "GlobalCompactSignatory": "global_compact_signatory",
    "GriReportGuidelines": "gri_reporting",
    "IntegratedStrategyInMdAndA": "integrated_mda",
    "SustainabilityCompensationIncentives": "esg_compensation",
}
# Rating time series.
RATINGS = {
    "ISSUER_NAME": "name",
    "ISSUER_ISIN": "isin",
    "AS_OF_DATE": "msci_as_of_date",
    "IVA_INDUSTRY": "msci_industry",
    "IVA_RATING_DATE": "msci_rating_date",
    "IVA_COMPANY_RATING": "msci_company_rating",
    "ENVIRONMENTAL_PILLAR_SCORE": "msci_env_score",
    "SOCIAL_PILLAR_SCORE": "msci_soc_score",
    "GOVERNANCE_PILLAR_SCORE": "msci_gov_score",
}
