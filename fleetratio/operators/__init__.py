from .bootstrap import boot_replicates, boot_summary, bootstrap_expand, bootstrap_ratio, vessel_rollup
from .expand import clean_report, expand_single, expand_to_fleet, repair_label, spread_domains
from .moments import (
    distinct_units,
    domain_groups,
    fleet_effort,
    observed_effort,
    sample_sizes,
    union_domains,
    zero_filled_bycatch,
)
from .prepare import (
    derive_fleet_strata,
    derive_observer_strata,
    detect_program,
    drop_empty_disposition,
    indicator_measure,
    numeric_year,
    program_normalise,
    restrict_to_sectors,
    round_measures,
    season_of_month,
    sector_filter,
    sectors_with_domain,
    state_of_agency,
    zero_fill,
)
from .quality import (
    cell_range,
    coverage,
    differing_ranges,
    flag_small_cells,
    key_quality,
    partition_total,
    possible_members,
    range_digests,
    reconcile,
    record_class_counts,
    row_counts,
    small_cells,
    ticket_match_rate,
    total_of_components,
    unobserved_strata,
    vessel_ticket_join,
)
from .quantiles import exact_quantiles
from .ratio import ratio_table
from .unsampled import expand_unsampled, failed_trips, nifq_haul_set
