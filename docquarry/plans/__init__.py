"""docquarry.plans"""
