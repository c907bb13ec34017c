"""The feature dictionary and the measurand catalogue."""

from __future__ import annotations

from runlens.constants import KPI_FEATURES
from runlens.operators import catalogue
from runlens.plans.queries.names import (
    CATALOGUE_SQL, FEATURE_LAYER_SQL, FEATURES_SQL, LAYER_SQL, PARSED_SQL,
)
from runlens.plans.registry import Tables, query
from runlens.plans.views import CATALOGUE, FEATURES

# min_by passes over nulls: the first row's missing text is marked and unmarked again.
DETAILS_SQL = "min_by(coalesce(key_type, '-'), pos) as key_type, min_by(coalesce(data_type, '-'), pos) as data_type," \
    " min_by(min_value, pos) as min_value, min_by(max_value, pos) as max_value"
KEY_TYPES = ["continuous (q = 5)", "discrete", "NA"]


@query("feature_measurand_join", f"""with f as (select *, replace(lower(measurand_prefix), '_', '') as p from {PARSED_SQL}),
 k as (select replace(lower(ue_logging), '_', '') as matched_key, min(pos) as pos, min_by(layer_raw, pos) as layer,
  min_by(priority, pos) as priority, {DETAILS_SQL} from {CATALOGUE_SQL} where ue_logging is not null group by 1),
 m as (select p, min_by(matched_key, pos) as matched_key, min_by(layer, pos) as layer, min_by(priority, pos) as priority, {DETAILS_SQL}
  from (select distinct p from f) join k on contains(p, matched_key) or contains(matched_key, p) group by p)
 select new_var_num, orig_var_name, measurand_prefix, feature_type, feature_value, matched_key, layer_group,
  coalesce(layer_raw, '') as layer_raw, cast(priority as bigint) as priority, coalesce(nullif(key_type, '-'), '') as key_type,
  coalesce(nullif(data_type, '-'), '') as data_type, min_value, max_value from (select *, {LAYER_SQL} as layer_group from
  (select f.*, m.matched_key, m.layer as layer_raw, m.priority, m.key_type, m.data_type, m.min_value, m.max_value from f left join m using (p)))""")
def feature_measurand_join(load: Tables):
    return catalogue.feature_map(load(FEATURES), load(CATALOGUE))


@query("priority_semi_join", f"""select new_var_num, orig_var_name, feature_type, feature_value from {PARSED_SQL} f
 where exists (select 1 from {CATALOGUE_SQL} c where c.priority = 3 and c.ue_logging <> ''
  and contains(lower(f.measurand_prefix), lower(c.ue_logging)))
 order by cast(substr(new_var_num, 2) as bigint), orig_var_name""")
def priority_semi_join(load: Tables):
    return catalogue.priority_features(load(FEATURES), load(CATALOGUE))


@query("kpi_feature_lookup", f"""select w.kpi, w.id as new_var_num, coalesce(f.orig_var_name, 'NOT FOUND') as orig_var_name
 from (values {', '.join(f"('{k}', '{x}')" for k, ids in KPI_FEATURES.items() for x in ids if not x.startswith('resolve'))}) w(kpi, id)
 left join {FEATURES_SQL} f on f.new_var_num = w.id""")
def kpi_feature_lookup(load: Tables):
    return catalogue.kpi_feature_lookup(load(FEATURES))


@query("layer_counts", f"""select {LAYER_SQL} as layer_group, count(meas_key) as n from {CATALOGUE_SQL}
 group by 1 order by n desc, layer_group""")
def layer_counts(load: Tables):
    return catalogue.layer_counts(load(CATALOGUE))


@query("priority_keytype_crosstab", f"""select cast(priority as bigint) as priority, {', '.join(
    f'''count(*) filter (where key_type = '{k}') as "{k}"''' for k in KEY_TYPES)}
 from {CATALOGUE_SQL} group by 1""")
def priority_keytype_crosstab(load: Tables):
    return catalogue.priority_keytype_crosstab(load(CATALOGUE), KEY_TYPES)


@query("catalogue_counts", f"""select 'feature_type' as counter, feature_type as item, count(*) as n from {PARSED_SQL} group by 2
 union all select 'priority', cast(priority as varchar(10)), count(*) from {CATALOGUE_SQL} group by 2
 union all select 'key_type', key_type, count(*) from {CATALOGUE_SQL} group by 2""")
def catalogue_counts(load: Tables):
    return catalogue.catalogue_counts(load(CATALOGUE), load(FEATURES))


@query("layer_priority_counts", f"""select {LAYER_SQL} as layer_group, cast(priority as bigint) as priority, count(*) as n
 from {CATALOGUE_SQL} group by 1, 2""")
def layer_priority_counts(load: Tables):
    return catalogue.layer_priority_counts(load(CATALOGUE))


@query("features_by_layer", f"select {FEATURE_LAYER_SQL} as layer_group, count(*) as n from {FEATURES_SQL} group by 1")
def features_by_layer(load: Tables):
    return catalogue.features_by_layer(load(FEATURES))


@query("feature_type_counts", f"select feature_type, count(*) as n from {PARSED_SQL} group by 1")
def feature_type_counts(load: Tables):
    return catalogue.feature_type_counts(load(FEATURES))


@query("topk_per_layer", f"""select * from (select {LAYER_SQL} as layer_group, pos, meas_key,
 substr(coalesce(description, ''), 1, 90) as description,
 cast(row_number() over (partition by {LAYER_SQL} order by pos) as integer) as place
 from {CATALOGUE_SQL} where priority = 3 and meas_key <> '') where place <= 6""")
def topk_per_layer(load: Tables):
    return catalogue.top_measurands(load(CATALOGUE))
