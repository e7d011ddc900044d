"""Writers: CSV, the profile's report, the RSS feed and the page."""
