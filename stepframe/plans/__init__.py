"""Whole jobs put together from the operators."""

from stepframe.plans.age_dimension import AGE_DIMENSION, SENTINELS, age_dimension, with_age_classes
from stepframe.plans.airlines import airlines_job, airlines_read
from stepframe.plans.cars import cars_job

__all__ = ["AGE_DIMENSION", "SENTINELS", "age_dimension", "with_age_classes", "airlines_job",
           "airlines_read", "cars_job"]
